import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from surveyspark.llm import chat_format as C
from surveyspark.llm.template import ChatTemplate, TemplateError, fold_body, parse

ROWS = "conv_id long, turn long, role string, text string"


@given(st.text(alphabet="\\<|turnexd>é🎉\n ", max_size=40))
def test_escape_is_reversible(text):
    assert C.unescape(C.escape(text)) == text
    reader, t = C.Reader(), ChatTemplate(C.TEMPLATE, C.FILTERS)
    piece, marks = t.piece({"role": "assistant", "text": text}, 1, True)
    reader.feed(piece, [{"start": a, "end": b} for a, b in marks])
    got = reader.digest(0)
    assert got["turns_sha256"] == hashlib.sha256(f"assistant\n{text}\n".encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_constants_fold():
    assert fold_body(parse("{% if 1 == 1 %}{{ 'a' + 'b' | upper }}c{% else %}{{ x }}{% endif %}"), C.FILTERS) == [("text", "aBc")]
    assert fold_body(parse("{% if false %}x{% elif y %}z{% endif %}"), C.FILTERS) == [("if", [(("name", "y"), [("text", "z")])])]


def test_loop_facts_and_sandbox():
    t = ChatTemplate("[{% for m in messages %}{% if not loop.first %},{% endif %}{{ loop.index }}{{ m.role.__class__ }}{% endfor %}]", {})
    pieces = [t.piece({"role": "u"}, i, i == 3)[0] for i in (1, 2, 3)]
    assert "".join(pieces) == "[1,2,3]"
    for bad in ("{% for m in messages %}", "{{ a( }}", "{% include x %}", "no loop", "{% for m in messages %}{{ m | nope }}{% endfor %}"):
        with pytest.raises(TemplateError):
            ChatTemplate(bad, C.FILTERS)


def test_digests_equal_a_plain_rendering(ready):
    rows = [(1, 1, "assistant", "b <|end|> \\"), (1, 0, "user", None), (1, None, None, "first"), (1, 1, "assistant", "b <|end|> \\"),
            (None, 0, "assistant", "x"), (2, 0, "user", "long " * 50_000), (3, 0, "system", "")]
    rows += [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(5000)]
    got = {r["conv_id"]: r for r in C.read_back(C.render(ready.createDataFrame(rows, ROWS).selectExpr("*", "1 as piece"))).collect()}
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((-1 if turn is None else turn, role or "", text or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[c]["formatted_chars"] == sum(len(C.escape(r)) + len(C.escape(x)) + 24 for _, r, x in turns)
    assert C.read_back(C.render(ready.createDataFrame([], ROWS))).count() == 0
    whole = C.conversations(C.render(ready.createDataFrame(rows[:3], ROWS))).first()["formatted"]
    assert whole.startswith("<|turn|><|text|>first<|end|>\n")
