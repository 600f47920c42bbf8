"""Word lists of the historical corpus, as defaults of parameters.

Fixed values: results depend on these words, so they stand as plain text.
"""

#: Lower-case words that lists of names may hold.
LIST_WORDS = (
    "of the and kn knt knight knights esq esquire with others diuers divers dive more some y ye lord lo earle vic visc viscount deputy deputie treasuror treasurer "
    "secretary secretarie auditor auditors alderman ald doctor capt captaine sir mr m right honorable hono honourable rolles wards excheq deane privie priuy seale keeper"
).split()
#: Titles before a name, as a pattern.
TITLES = r"captaine?|captayne|capt\.?|cap[’'*:.]+|sir|lady|lord|doctor|dr\.?|master|mistress|mrs?\.?|[ms][’'*™]+|mt"
#: Words that make a shape an office, a commodity or a fragment, and not a name.
NON_NAMES = (
    "attorney atturney president treasuror treasurer deputy deputie auditor recorder chancellor keeper secretary present item the king kinge generall majesty silke madder corne tobacco "
    "sassafras wine pitch tarre iron dated account accompt bill debt receipt january february march april iune june iuly july august september october november december"
).split()
#: Trades that follow a name.
TRADES = "carpenter labourer laborer gent gentleman esq esquire merchant grocer mariner sawyer yeoman husbandman joyner bricklayer haberdasher vintner draper minister preacher surgeon planter servant widow".split()
#: Classes of territorial titles in the text before a place, in this order.
TERRITORIAL = (
    ("mayor", r"(?:lord\s+)?ma(?:i|y)or\s+of\s*$"),
    ("bishop", r"(?:lord\s+)?(?:arch)?bishop\s+of\s*$"),
    ("earl", r"(?:earle?|countesse?)\s+of\s*$"),
    ("lord", r"lord\s+(?:of\s*)?$"),
    ("peer", r"(?:duke|marquesse?|viscount|baron)\s+(?:of\s*)?$"),
)
#: Countries of the royal style, as patterns.
COUNTRIES = r"gr[e]?a[e]?te?\s+brit+[ae]?[iy]?n+e?|england|englande|ingland|eng-\s*land|scotland|scottland|scot-\s*t?land|france|fraunce|ffrance|ffraunce|firaunce|ireland|irland|ire-\s*land"
#: Phrases that name countries without meaning places: the royal style, then regnal years.
STYLES = (
    ("royal_style", rf"(?i)(?<![\p{{L}}\p{{N}}])(?:{COUNTRIES})(?:[\s,;.&]+(?:and\s+)?(?:{COUNTRIES})){{2,3}}(?![\p{{L}}\p{{N}}])"),
    ("regnal_year", rf"(?i)(?<![\p{{L}}\p{{N}}])(?:and\s+)?of\s+(?:{COUNTRIES})\s+the\s+(?:[a-z]+[\s-]+){{0,4}}?(?:[a-z]*(?:th|first|second|third)|\d+(?:th|st|nd|rd)?)(?![\p{{L}}\p{{N}}])"),
)
#: Given names that clerks cut short.
SHORT_NAMES = "nich nicho ed edw dan tho io jo wm geo ro rob rich sam hen fra chr nath will willm".split()

#: Labels of spans that are roles, bodies or no entities.
ROLE_LABELS = {
    "counsel": "ORG_OR_COMMITTEE",
    "counsell": "ORG_OR_COMMITTEE",
    "councell": "ORG_OR_COMMITTEE",
    "councel": "ORG_OR_COMMITTEE",
    "deputy": "TITLE_OR_ROLE",
    "deputie": "TITLE_OR_ROLE",
    "nos": "EDITORIAL_REFERENCE",
    "nos.": "EDITORIAL_REFERENCE",
    "treasurer": "TITLE_OR_ROLE",
    "majesty": "TITLE_OR_ROLE",
    "ibid": "NOT_ENTITY",
    "statutes": "NOT_ENTITY",
    "ma": "TITLE_OR_ROLE",
    "generall": "TITLE_OR_ROLE",
    "kinge": "TITLE_OR_ROLE",
    "nauie": "NOT_ENTITY",
    "labo": "NOT_ENTITY",
}
#: Aliases of one word that stand for a person alone.
SINGLE_NAMES = ["pocahontas", "matoaka", "amonute"]
#: Reasons of exclusion that say that a form is no person at all.
NO_PERSON_REASON = (
    r"(?i)^(?:place|ship|office|archive|modern|document|institution|heading|feast|phrase|legal|"
    r"meeting|bod|law|object|latin|royal|placeholder|'your|'his|'excellent|fragment|title only|"
    r"truncated|compound|descriptive|theological|'every|'main|directional|osnaburg|ocr of)"
)
NO_ENTITIES = [
    "Counsell", "Councell", "Counsel", "Councel", "Deputy", "Deputie", "Treasurer", "Treasuror",
    "Majesty", "Maiestie", "Ibid", "Statutes", "Cape Merchant", "Cape Marchant", "Cape Mercht",
]
#: Three of these make a margin note a piece of an attendance list.
LIST_ENTRY = r"(?:^|[.\s])(?:m\W{0,2}|mr\.?|s\W|sir|capt\W*|lo\W|dr\W*|d\W)\s*[A-Z][\w’'*:]+"
