"""surveyspark: weighted, clustered survey analytics as Spark DataFrame operators.

Every operator takes DataFrames and column names and returns a DataFrame (or a
small fitted object), so the same code runs on a sample and on a cluster-sized
table. Sub-packages:

- ``sources``   readers and writers (SRC, SNK)
- ``functions`` column-expression helpers, fixed lookup values, vectorised UDFs
- ``operators`` cleaning, derivation, profiling, splits, features, models,
                evaluation, inference and scoring
- ``streaming`` Structured Streaming scoring and history KPIs
- ``plans``     operators bound to the test tables, with their oracle SQL
"""

from surveyspark.session import get_session, checkpoint_dir

__all__ = ["get_session", "checkpoint_dir"]
