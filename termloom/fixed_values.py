"""Results are only right if these equal the published rule set.

Everything in this file is data, in its natural order; order is meaning for the
rule lists, because the first rule that matches wins.
"""

# --- Fixed values: seasons -------------------------------------------------
CYCLONE_SEASON = "saison_cyclonique"
HIGH_SEASON = "haute_saison"
CYCLONE_MONTHS = (1, 3)  # first and last month, both included

MONTH_LABELS = [
    "Jan", "Fév", "Mar", "Avr", "Mai", "Juin",
    "Juil", "Août", "Sep", "Oct", "Nov", "Déc",
]

# --- Fixed values: seeds, markets, expansion -------------------------------
SEEDS = {
    "fr": [
        "excursion nosy be",
        "circuit madagascar",
        "tour operateur madagascar",
        "agence de voyage madagascar",
        "que faire nosy be",
        "voyage madagascar",
        "excursion ile aux nattes",
        "safari madagascar",
        "croisiere nosy be",
        "sejour madagascar",
    ],
    "en": [
        "excursion nosy be",
        "madagascar tour package",
        "madagascar travel agency",
        "things to do nosy be",
        "madagascar trip",
        "madagascar safari tour",
        "nosy be day trip",
        "madagascar vacation",
    ],
    "de": [
        "ausflug nosy be",
        "madagaskar reise",
        "madagaskar rundreise",
        "reiseveranstalter madagaskar",
        "madagaskar urlaub",
    ],
    "it": [
        "escursione nosy be",
        "tour madagascar",
        "tour operator madagascar",
        "agenzia di viaggi madagascar",
        "cosa fare a nosy be",
        "viaggio madagascar",
        "vacanza madagascar",
        "safari madagascar",
        "crociera nosy be",
    ],
}
MARKETS = ["", "FR", "DE", "US", "IT"]
WORLDWIDE_LABEL = "monde"
ALPHABET = "abcdefghijklmnopqrstuvwxyz"
INTEREST_BATCH_SIZE = 5
TOP_KEYWORDS = 15
TOP_WORDS = 15
SUGGESTION_SOURCE = "google_autocomplete"

# --- Fixed values: intent rules --------------------------------------------
NAVIGATIONAL = [
    r"tripadvisor", r"trip advisor", r"booking\.com", r"\bbooking\b",
    r"getyourguide", r"get your guide", r"\bviator\b", r"lonely planet",
    r"\bexpedia\b", r"\bklook\b", r"\bcivitatis\b", r"\bkayak\b",
    r"\bskyscanner\b", r"\bopodo\b", r"holidaycheck",
    r"wikitravel", r"wiki travel", r"wikivoyage",
]
TRANSACTIONAL = [
    r"\bprix\b", r"pas cher", r"\btarif", r"r[ée]server", r"r[ée]servation",
    r"\bdevis\b", r"combien co[uû]te",
    r"\bprice\b", r"\bcost\b", r"\bcheap\b", r"\bbook\b", r"\bbooking\b",
    r"how much", r"\bpackage", r"\bbudget\b", r"\bdeals?\b",
    r"\ball inclusive\b", r"\btravel now\b",
    r"\bpreis\b", r"g[uü]nstig", r"\bkosten\b", r"\bbuchen\b", r"\bbuchung",
    r"\bprezzo\b", r"economic", r"\bprenota", r"\bcosto\b",
]
INFORMATIONAL = [
    r"\bque faire\b", r"\bcomment\b", r"\bpourquoi\b", r"\bavis\b", r"\bblog\b",
    r"\bconseil", r"\bguide\b", r"itin[ée]raire", r"\bquand\b",
    r"\bhow to\b", r"\bwhat to\b", r"\bwhy\b", r"\breview", r"\btips\b",
    r"\bguide\b", r"\bitinerary\b", r"\bwhen\b", r"\bbest time\b",
    r"\bis\b", r"\bare\b", r"\bdo i\b", r"\bdoes\b", r"\bcan\b",
    r"\bhow many\b", r"\bhow safe\b",
    r"\bthings to (do|see)\b",
    r"\btravel advisory\b", r"\btravel warning\b", r"\btravel advice\b",
    r"\bstate gov\b", r"\bvisa polic", r"\bvisa requirement",
    r"\btravel alert\b", r"\btravel ban\b", r"\bcdc\b", r"\bdanger\b",
    r"\bguidance\b", r"\bhealth\b", r"\bhealthy\b", r"\bexpensive\b",
    r"\bexperience\b", r"\bbrochure\b", r"\bindependent\b", r"\bgay\b",
    r"\blgbt\b", r"\bdestinations?\b",
    r"\btravel (in )?(january|february|march|april|may|june|july|august|september|october|november|december)\b",
    r"\b(january|february|march|april|may|june|july|august|september|october|november|december) travel\b",
    r"\binformation\b", r"\binsurance\b", r"\bkids?\b", r"\blevel\b",
    r"\bmalaria\b", r"\btravel mate\b", r"\bmedicine\b", r"\bnews\b",
    r"\bplaces\b", r"\bplan\b", r"\breport\b", r"\brequirements?\b",
    r"\brestrictions?\b", r"\brisk\b", r"\broute\b", r"\bsafe\b",
    r"\bsafety\b", r"\bseason\b", r"\bsolo\b", r"\bstatus\b", r"\btime\b",
    r"\btravel uk\b", r"\bupdate\b", r"\btravel us\b", r"\bvaccines?\b",
    r"\bvideo\b", r"\bvisa\b", r"\bvlog\b", r"\byoutube\b", r"\bzoos?\b",
    r"\bbeaches\b", r"\btravel canada\b", r"\btravel from india\b",
    r"\bwie\b", r"\bwarum\b", r"\berfahrung", r"\btipps\b", r"reisef[uü]hrer",
    r"\bwann\b", r"\breddit\b", r"\bplanen\b", r"highlights?\b", r"\bbilder\b",
    r"\baktuell\b", r"reise wert", r"urlaub wert", r"was beachten",
    r"\bsprache\b", r"\bgef[aä]hrlich\b", r"\bforum\b", r"reisezeit", r"jahreszeit",
    r"\bwohin\b", r"\bkarte\b",
    r"reisebericht", r"reiseblog", r"reisewarnung", r"reiseziel",
    r"\bcome\b", r"\bperch[eé]\b", r"\brecensioni\b", r"\bconsigli\b",
    r"\bitinerario\b", r"\bquando\b", r"cosa portare", r"\bmappa\b", r"\bmap\b",
    r"cosa fare\b", r"cosa vedere",
]
COMMERCIAL = [
    r"\btrips?\b", r"\btours?\b", r"\bvacation\b", r"\bholiday",
    r"\btravel agen(cy|cies|t|ts)\b", r"\btravel compan(y|ies)\b", r"\btravel service\b",
    r"\bluxury\b", r"\bspecialist\b", r"\btravel online\b",
    r"\bvoyage\b", r"\bcircuit\b", r"\bs[ée]jour\b", r"\bexcursions?\b",
    r"\breisen?\b", r"\burlaub\b", r"\brundreise\b",
    r"reiseveranstalter", r"ausflug", r"luxusurlaub",
    r"\bviaggio\b", r"\bvacanza\b", r"\bsafari\b", r"\bescursion[ei]\b",
    r"\bagenzia\b", r"\bcrociera\b",
]
INTENT_NAVIGATIONAL = "navigationnel"
INTENT_TRANSACTIONAL = "transactionnel"
INTENT_INFORMATIONAL = "informationnel"
INTENT_COMMERCIAL = "commercial"
INTENT_EXCLUDED = "exclure"
RULE_MANUAL = "manuel"
RULE_COMMERCIAL_PREFIX = "commercial:"
CATEGORY_NAMES = [
    "NAVIGATIONAL_PATTERNS", "TRANSACTIONAL_PATTERNS",
    "INFORMATIONAL_PATTERNS", "COMMERCIAL_PATTERNS",
]
CATEGORY_JOINER = " + "

# --- Fixed values: noise rules ---------------------------------------------
COMPETITOR = [
    "tui", "leclerc", "fram", "kuoni", "nouvelles frontières", "nouvelles frontieres",
    "club med", "carrefour", "bourdon", "air france",
    "jet2", "british airways", "virgin", "mercury holidays", "kensington tours",
    "intrepid", "gebeco", "marco polo", "turisanda", "holidaycheck", "world insight",
    "dadamanga", "jangaria", "wilderness travel",
]
OFF_TOPIC = [
    r"\bmovie\b", r"\bapk\b", r"automobile", r"\bchien\b",
    r"recrutement", r"comment créer", r"chiffres", r"\bfilm\b",
    r"liste tour opérateur", r"tour operateur professionnel",
    r"release date", r"centella", r"skin1004",
    r"national holidays?\b", r"official holidays?\b", r"major holidays?\b",
    r"amazon prime", r"grand tour bentley",
    r"vanilla travel (size|spray)",
    r"\bevolution travel\b", r"\btravel kit\b", r"\btravel set\b",
    r"\btravel song\b", r"\btravel poster\b", r"\bossan\b",
    r"\btriplets\b", r"what (does|do) .+ mean\b", r"\btravel to$",
]

# --- Fixed values: language markers ----------------------------------------
LANGUAGE_MARKERS = {
    "fr": [
        r"\bdepuis\b", r"\ben mer\b", r"\bdu\b", r"\bdes\b", r"\bde\b", r"\bavec\b",
        r"\bsans\b", r"\bchez\b", r"\bpourquoi\b", r"\bcombien\b", r"\boù\b",
        r"qu'est-ce",
    ],
    "de": [
        r"\bund\b", r"\bnach\b", r"\bf[uü]r\b", r"\bmit\b", r"\bohne\b",
        r"\bwarum\b", r"\bwann\b", r"wie viel", r"\breise\b", r"\burlaub\b",
    ],
    "it": [
        r"perch[eé]", r"per[oò]", r"\bsenza\b", r"quanto costa",
        r"dove andare", r"\bviaggio\b", r"\bvacanza\b",
    ],
}
OVERRIDE_LANGUAGES = ["fr", "en", "de", "it"]

# --- Fixed values: themes by seed prefix -----------------------------------
THEME_PREFIXES = [
    ("excursion ile aux nattes", "excursions_mer"),
    ("excursion nosy be", "excursions_mer"),
    ("croisiere nosy be", "excursions_mer"),
    ("circuit madagascar", "circuits_multijours"),
    ("safari madagascar", "safari"),
    ("sejour madagascar", "hebergement"),
    ("agence de voyage madagascar", "agences_prestataires"),
    ("tour operateur madagascar", "agences_prestataires"),
    ("que faire nosy be", "activites_infos"),
    ("voyage madagascar", "voyage_generique"),
]
DEFAULT_THEME = "autre"

# --- Fixed values: words left out of the word-frequency report --------------
STOPWORDS = [
    "madagascar", "madagaskar", "nosy", "be", "de", "du", "la", "le", "les",
    "à", "en", "et", "for", "the", "a", "an", "of", "to", "in", "und", "der",
    "die", "das", "di", "il", "la", "per", "e",
]

# --- Fixed values: what counts as blank when stripping text -----------------
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0"
    "\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
