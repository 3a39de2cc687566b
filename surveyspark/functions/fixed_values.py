"""Fixed values that results depend on.

FIXED VALUES: these lists and maps must equal the survey's coding so that
cleaning, derived indicators and labels come out right. They are stated as
plain data, in the survey's natural order, and used only through the
parametric operators (which accept any other mapping too).
"""

# --- fixed values: raw survey code -> readable column name -------------------
RAW_TO_NAME = {
    "v001": "numerogruppe", "v002": "numeromenage", "v005": "poidsdesondage",
    "v022": "stratedesondage", "v024": "region", "v025": "milieuderesidence",
    "v008": "datedelinterview", "hw1": "ageenfant", "b4": "sexeenfant",
    "bord": "rangdenaissance", "b11": "intervalleintergenesique",
    "m18": "tailleanaissance", "m34": "dureeallaitement", "h11": "diarrhee",
    "h0": "vaccinpolio0", "h1": "cartesante", "h2": "vaccinbcg",
    "h3": "vaccindtp1", "h4": "vaccinpolio1", "h5": "vaccindtp2",
    "h6": "vaccinpolio2", "h7": "vaccindtp3", "h8": "vaccinpolio3",
    "h9": "vaccinrougeole1", "h10": "vaccine_status", "v012": "agemere",
    "v106": "niveauinstructionmere", "v445": "imcmere", "v438": "hemoglobinemere",
    "v743a": "prisededecisionmere", "v501": "statutmatrimonialmere",
    "v201": "nombreenfantsnesvivants", "m14": "nombrevisitesprenatales",
    "v190": "indicederichesse", "v113": "sourceeaupotable",
    "v116": "typeinstallationssanitaires", "v161": "typecombustiblecuisine",
    "v136": "nombremembresmenage", "v102": "lieuderesidence",
    "v101": "regionecologique", "hw5": "scoreztaillepourage",
    "hw8": "scorezpoidspourtaille", "hw11": "scorezpoidspourage",
    "hw13": "indicateurdevalidite",
}

# --- fixed values: sentinel codes ---------------------------------------------
Z_SCORE_SENTINELS = [9998, 9999]          # anthropometric z x 100: flagged / missing
Z_SCORE_RANGE = (-600, 600)               # valid z x 100
BMI_SENTINELS = [9998, 9999]              # v445 before /100
HAEMOGLOBIN_SENTINELS = [998, 999]        # v438 before /10
GENERIC_SENTINELS = [97, 98, 99, 997, 998, 999]
STUNTING_CUTOFF = -200                    # z x 100 below -2 sd

CONTINUOUS_FIELDS = ["hw1", "v012", "v445", "v438", "v136", "b11", "m14", "m34",
                     "bord", "v201", "v008"]

CATEGORICAL_FIELDS = ["b4", "v025", "v106", "v190", "v024", "m18", "h10", "h11",
                      "v743a", "v501", "v113", "v116", "v161", "v102", "v101",
                      "h2", "h3", "h4", "h5", "h7"]

# --- fixed values: per-column missing-code rules (codes -> target code) -------
MISSING_RULES = {
    "m15": ([8, 9], 9), "m34": ([98, 99], 99), "h10": ([8, 9], 9),
    "h11": ([8, 9], 9), "h1": ([8, 9], 9), "h2": ([8, 9], 9), "h3": ([8, 9], 9),
    "h4": ([8, 9], 9), "h5": ([8, 9], 9), "h6": ([8, 9], 9), "h7": ([8, 9], 9),
    "h8": ([8, 9], 9), "h9": ([8, 9], 9), "v743a": ([8, 9], 9),
    "v501": ([8, 9], 9), "v113": ([97, 98, 99], 99), "v116": ([97, 98, 99], 99),
    "v161": ([97, 98, 99], 99),
    # the fields without a published rule: only their non-response codes, never a valid code
    "b4": ([9], 9), "v025": ([9], 9), "v106": ([8, 9], 9), "v190": ([9], 9),
    "v024": ([98, 99], 99), "m18": ([8, 9], 9), "v102": ([9], 9), "v101": ([98, 99], 99),
}
DEFAULT_MISSING_RULE = ([8, 9, 98, 99], 9)

# --- fixed values: improved water / sanitation, risk codes --------------------
IMPROVED_WATER = [11, 12, 13, 21]
UNIMPROVED_WATER = [43, 61, 41]
IMPROVED_TOILET = [11, 12, 21]
UNIMPROVED_TOILET = [22, 31]
POLLUTING_FUEL = [7, 8]
CLEAN_FUEL = [1, 2]
HIGH_PREVALENCE_REGIONS = [5, 7, 1, 4]
POOREST_QUINTILES = [1, 2]
RURAL = 2

# --- fixed values: region code -> name, latitude, longitude ------------------
REGIONS = [
    (1, "Adamaoua", 7.33, 13.58), (2, "Centre", 4.57, 11.52),
    (3, "Douala", 4.05, 9.70), (4, "Est", 4.25, 13.50),
    (5, "Extreme-Nord", 10.60, 14.32), (6, "Littoral", 4.60, 10.00),
    (7, "Nord", 9.30, 13.39), (8, "Nord-Ouest", 6.07, 10.15),
    (9, "Ouest", 5.48, 10.42), (10, "Sud", 2.84, 10.92),
    (11, "Sud-Ouest", 5.00, 9.20), (12, "Yaounde", 3.87, 11.52),
]

# --- fixed values: code -> label for the coded variables ----------------------
LABELS = {
    "milieuderesidence": {1: "Urbain", 2: "Rural"},
    "sexeenfant": {1: "Masculin", 2: "Feminin"},
    "niveauinstructionmere": {0: "Aucun niveau", 1: "Primaire", 2: "Secondaire", 3: "Superieur"},
    "indicederichesse": {1: "Plus pauvre", 2: "Pauvre", 3: "Moyen", 4: "Riche", 5: "Plus riche"},
    "tailleanaissance": {1: "Tres grand", 2: "Plus grand que la moyenne", 3: "Moyen",
                         4: "Plus petit que la moyenne", 5: "Tres petit", 9: "Manquant/Inconnu"},
    "prisededecisionmere": {1: "Repondante seule", 2: "Repondante et conjoint", 3: "Conjoint seul",
                            4: "Quelquun dautre", 9: "Inconnu"},
    "statutmatrimonialmere": {0: "Jamais mariee", 1: "Mariee", 2: "Vivant en union", 3: "Veuve",
                              4: "Divorcee", 5: "Separee", 9: "Inconnu"},
    "sourceeaupotable": {11: "Robinet maison", 12: "Robinet cour", 13: "Fontaine publique",
                         21: "Forage", 41: "Puits ouvert", 43: "Source non protegee",
                         61: "Eau de surface", 99: "Manquant/Inconnu"},
    "typeinstallationssanitaires": {11: "Chasse degout", 12: "Chasse fosse septique",
                                    21: "Latrine amelioree VIP", 22: "Latrine ouverte sans dalle",
                                    31: "Pas de toilettes/Nature", 99: "Manquant/Inconnu"},
    "typecombustiblecuisine": {1: "Electricite", 2: "Gaz GPL", 7: "Charbon de bois",
                               8: "Bois de chauffe", 95: "Pas de cuisine", 99: "Manquant/Inconnu"},
    "regionecologique": {1: "Soudanosahelienne", 2: "Hautealtitude", 3: "Guineennegravifere",
                         4: "Equatorialeforestiere"},
    "diarrhee": {0: "Pas de diarrhee", 1: "Oui (derniere 24h)", 2: "Oui (2 dernieres semaines)",
                 9: "Inconnu"},
    "vaccine_status": {0: "Non", 1: "Oui", 8: "Je ne sais pas"},
}

# --- fixed values: code -> label of the frequency tables ----------------------
VACCINATION = {0: "Non", 1: "Date de vaccination sur la carte", 2: "Signalé par la mère", 3: "Vaccination indiquée sur la carte"}
FREQUENCY_LABELS = {
    "sexeenfant": {1: "Masculin", 2: "Féminin"},
    "milieuderesidence": {1: "Urbain", 2: "Rural"},
    "niveauinstructionmere": {0: "Aucun", 1: "Primaire", 2: "Secondaire", 3: "Supérieur"},
    "indicederichesse": {1: "Plus pauvre", 2: "Pauvre", 3: "Moyen", 4: "Riche", 5: "Plus riche"},
    "region": {1: "Adamaoua", 2: "Centre (sans Yaoundé)", 3: "Douala", 4: "Est", 5: "Extrême-Nord", 6: "Littoral (sans Douala)",
               7: "Nord", 8: "Nord-Ouest", 9: "Ouest", 10: "Sud", 11: "Sud-Ouest", 12: "Yaoundé"},
    "tailleanaissance": {1: "Très gros", 2: "Plus gros que la moyenne", 3: "Moyen", 4: "Plus petit que la moyenne", 5: "Très petit"},
    "vaccinbcg": VACCINATION,
    "diarrhee": {0: "Pas de diarrhée", 1: "Oui (dernières 24h)", 2: "Oui (2 dernières semaines)"},
    "prisededecisionmere": {1: "Répondante seule", 2: "Répondante et conjoint", 3: "Conjoint seul", 4: "Quelqu'un d'autre",
                            5: "Répondante et autre personne"},
    "statutmatrimonialmere": {0: "Jamais mariée", 1: "Mariée", 2: "Union libre / Cohabitation", 3: "Veuve", 4: "Divorcée", 5: "Séparée"},
    "sourceeaupotable": {11: "Eau courante: dans le logement", 12: "Eau courante: dans la cour/parcelle", 13: "Eau courante: robinet public",
                         21: "Puits tubé / forage", 31: "Puits creusé protégé", 32: "Puits creusé non protégé", 41: "Source protégée",
                         42: "Source non protégée", 51: "Eau de pluie", 61: "Camion-citerne", 62: "Boutique / Charette avec petite citerne",
                         71: "Eau de surface (rivière/barrage/lac)", 91: "Eau en bouteille", 92: "Eau en sachet (Pure Wata)"},
    "typeinstallationssanitaires": {11: "Chasse d'eau: branchée à un égout", 12: "Chasse d'eau: fosse septique",
                                    13: "Chasse d'eau: latrines à fosse", 14: "Chasse d'eau: vers un endroit inconnu",
                                    21: "Latrines à fosse améliorées ventilées (VIP)", 22: "Latrines à fosse avec dalle",
                                    23: "Latrines à fosse sans dalle / fosse ouverte", 31: "Toilettes à compostage",
                                    41: "Toilettes suspendues / sur pilotis", 51: "Pas de toilettes / nature / brousse"},
    "typecombustiblecuisine": {1: "Électricité", 2: "Gaz de pétrole liquéfié (GPL) / Gaz butane", 3: "Kérosène / Pétrole lampant",
                               4: "Charbon de bois", 5: "Bois de chauffe", 6: "Paille / Arbustes / Herbe", 7: "Cultures / Déchets agricoles",
                               8: "Bouse d'animaux", 95: "Ne cuisine pas à la maison"},
    "lieuderesidence": {1: "Urbain", 2: "Rural"},
    "regionecologique": {1: "Adamaoua", 2: "Centre", 3: "Est", 4: "Extrême-Nord", 5: "Littoral", 6: "Nord", 7: "Nord-Ouest", 8: "Ouest",
                         9: "Sud", 10: "Sud-Ouest"},
    "vaccinpolio0": VACCINATION,
    "cartesante": {0: "Aucune carte", 1: "Oui vu", 2: "Oui pas vu", 3: "Je n'ai plus de carte"},
    "vaccindtp1": VACCINATION, "vaccinpolio1": VACCINATION, "vaccindtp2": VACCINATION, "vaccinpolio2": VACCINATION,
    "vaccindtp3": VACCINATION, "vaccinpolio3": VACCINATION, "vaccinrougeole1": VACCINATION,
    "vaccine_status": {0: "Non", 1: "Oui"},
}

# --- fixed values: model term -> display label (exact term match) ------------
TERM_LABELS = {
    "C(sexeenfant)[T.2]": "Sexe de l'enfant : Feminin (Ref: Masculin)",
    "C(milieuderesidence)[T.2]": "Milieu de residence : Rural (Ref: Urbain)",
    "C(education_mere_opt)[T.1]": "Education Mere : Primaire (Ref: Aucun)",
    "C(education_mere_opt)[T.2]": "Education Mere : Secondaire/Superieur (Ref: Aucun)",
    "C(eau_amelioree)[T.1]": "Source d'eau : Amelioree (Ref: Non amelioree)",
    "C(toilettes_ameliorees)[T.1]": "Sanitaires : Ameliores (Ref: Non ameliores)",
    "ageenfant_carre": "Age de l'enfant au carre (Effet Courbe)",
    "ageenfant": "Age de l'enfant (en mois)",
}

# --- fixed values: text nulls --------------------------------------------------
TEXT_NULLS = ["NA", "na", "", "nan", "NaN"]

# --- fixed values: decision cut-offs -------------------------------------------
CLASS_CUTOFF = 0.5
ALERT_CUTOFFS = {"stunting": 0.30, "wasting": 0.15, "underweight": 0.20}
RISK_COLOUR_CUTS = (0.30, 0.50)            # green < .30 <= amber < .50 <= red
CONTRIBUTION_COLOUR_CUTS = (20.0, 40.0)    # green <= 20 < amber <= 40 < red
QUALITY_GATE_AUC = 0.70
