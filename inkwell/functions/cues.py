"""Patterns of the words that relate two names, as defaults of parameters.

Fixed values: results depend on these patterns, so they stand as they are, together.
All are matched in normal text (lower case, single spaces).
"""

OFFICE = (
    r"(?:governo\w*|gouerno\w*|gouernour|captaine generall|treasur\w*|deputy|deputie|marshall|"
    r"admirall|vice-?admirall|commander|comaunder|minister|preacher|bishop|warden|alderman|mayor|maior|"
    r"burgess\w*|secretar\w*|recorder|cape ?m[ae]r?chant|lieutenant|lieuten\w*|liuetenn\w*|fellowe?|"
    r"master|president|chiefe|agent|factor|surveyor|physition|phisition|steward|clerke|clarke)"
)
SEAT = r"(?:house|howse|plantation|plantacon|plantaéon|divident|dividend|land|lande|lands|seat|seate|fort|store|parish)"
NUMBER = r"(?:#|\d+|[ivxl]+|one|two|three|foure|four|fiue|five|six|seauen|seven|ten|twenty|hundred|thousand)"
KIN = (
    r"(?:wife|wyfe|widdow\w*|widow\w*|relict|sonne|son|daughter|daughte\w*|brother|sister|father|mother|"
    r"vncle|uncle|nephew|neece|cosen|cousin|kinsman|kinswoman|heire|heyre|executrix)"
)
AGENT = (
    r"(?:servant\w*|seruant\w*|man|men|apprentice|factor|agent|deputy|deputie|attorney|atturney|"
    r"executor|executo\w*|administrator|assigne\w*|partner|associate|tenant\w*)"
)
ARRIVE = (
    r"(?:came|come|cominge|comming|arrived|arriued|returned|retourned|returninge|sett saile|set sayle|"
    r"sailed|sayled|fled|departed|escaped|lately come|newly come)"
)
LEAD = r"(?:who|that|wch|which|being|beinge|lately|latelie|newly|now|nowe|is|was|were|hath|had|having|haueing|haue|then|since)"
TOWNSHIP = r"(?:the\s+(?:company|colony|colonie|plantation|cittie|citty|city|corporation|burrough|towne|church)\s+(?:of|for|at|in)\s*)?"
COUNTY = r"(?:the\s+(?:cittie|citty|city|county|countie|parish|towne|town|isle|iland|island)\s+of\s*)?"

# Between a person and a place.
OFFICE_IN = rf"\b{OFFICE}\b[^;]{{0,50}}?\b(?:of|for|at|in|ouer|over)\s*{TOWNSHIP}(?:the\s+)?$"
COMMANDS = r"\b(?:command|comand|comaund|charge|gouernment|government)\b[^;]{0,30}?\b(?:of|at|ouer|over)\s*(?:the\s+)?$"
PROPERTY_AT = rf"\b(?:his|her|their)\s+(?:\w+\s+)?{SEAT}\b[^;]{{0,25}}?\b(?:at|att|in|of|vppon|vpon|upon|neere|near)\s*(?:the\s+)?$"
LAND_AT = (
    rf"\b(?:{NUMBER}\s*(?:acres?|shares?)|acres?|divident|dividend|patent|pattent)\b[^;]{{0,50}}?\b(?:at|att|in|of|"
    r"vppon|vpon|upon|neere|near|adioyning|adjoyning|bordering|called)\s*(?:the\s+)?$"
)
KILLED_AT = r"\b(?:slaine|slayne|slain|killed|kild|massacred|murthered|murdered)\b[^;]{0,30}?\b(?:at|att|in)\s*(?:the\s+)?$"
TRAVEL_TO = (
    r"\b(?:sent|sente|send|sendinge|went|goe|goinge|gone|came|come|cominge|arrived|arriued|arriving|sailed|sayled|"
    r"saile|sayle|shipped|shipt|transported|transport\w*|bound|voyage|voyadge|passage|remoued|removed|"
    r"imployed|employed)\b[^;]{0,45}?\b(?:to|vnto|unto|into|for|towards?|at|att)\s*(?:the\s+)?$"
)
TRAVEL_FROM = rf"^[,\s]*(?:{LEAD}\s+)*{ARRIVE}\b[^;:,()]{{0,30}}?\b(?:from|out of)\s*(?:the\s+)?$"
RESIDENT_OF = (
    r"^[,\s]*(?:(?:late|nowe?|lately)\s+)?(?:(?:dwelling|dwellinge|liuing|liuinge|living|inhabitant|inhabitants|"
    rf"planter|planters|resident|seated|planted|settled|abiding|borne)\s+)?(?:of|in|at|att)\s*{COUNTY}(?:the\s+)?$"
)
WRITTEN_FROM = r"^[^;]{0,60}?\bfrom\s*(?:the\s+)?$"
LETTER_WORD = r"\b(?:indorsed|endorsed|letter|lerrer|lettre|lre|tre|lres|tres|written|writt|writ|dated?)\b"
ADDRESSEE = r"\b(?:to|vnto|unto)\s*$"
# Between a person and a group.
ACTION_AGAINST = r"\b(?:vppon|vpon|upon|against|agaynst|agst|ouer|over|march\w*|expedition\w*)\s*(?:the\s+)?$"
TRADE_WITH = r"\b(?:trade|trad\w*|trucke|truck|traffique|traffick\w*|deale|dealt|corne)\b[^;]{0,30}?\b(?:with)\s*(?:the\s+)?$"
PEACE_WITH = r"\b(?:peace|league|treaty|treatie|amity|amitie|friendship|frendship)\b[^;]{0,25}?\b(?:with)\s*(?:the\s+)?$"
# Between two people.
KIN_OF = rf"^[,\s]*(?:the\s+)?{KIN}\s+(?:of|to|vnto|unto)\s*(?:the\s+(?:said|late)\s+|his\s+|her\s+)?$"
AGENT_OF = rf"^[,\s]*(?:the\s+)?(?:\w+\s+)?{AGENT}\s+(?:of|to|vnto|unto|for)\s*(?:the\s+said\s+|his\s+)?$"
LETTER_TO = r"\b(?:letter|lerrer|letrer|lettre|lre|tre|letters|lres|tres|wrote|writ|written)s?\b[^;]{0,20}?\b(?:to|vnto|unto)\s*$"
COMPLAINT_AGAINST = r"\b(?:against|agaynst|agst|complain\w*|complayn\w*|accus\w*|suit|sute)\b[^;]{0,20}?\s*(?:the\s+said\s+)?$"
TRANSFER_TO = (
    r"\b(?:assigned|assigne|sold|solde|passed|pass|graunted|granted|surrendred|surrendered|bequeathed|given|giuen|"
    r"made ouer|transferred|alienated|conveyed)\b[^;]{0,45}?\b(?:to|vnto|unto)\s*$"
)
MARRIED = r"\b(?:married|marryed|maried|marrying|marriage)\b[^;]{0,20}?\b(?:to|with|vnto|unto)\s*$"
LETTER_HEAD = r"^\W*(?:a\s+)?(?:letter|lerrer|letrer|lettre|lre|tre)s?\s+(?:to|vnto|unto)\s*$"
HIS_KIN = rf"^[,\s]*(?:his|her)\s+{KIN}\s*$"
HIS_AGENT = rf"^[,\s]*(?:his|her)\s+{AGENT}\s*$"
TO = r"^(?:to|vnto|unto)$"
FOR_SHARES = rf"^\W*for\s+{NUMBER}\s*(?:shares?|acres?)"
# Between a place and a person after it.
OF_PERSON = r"^\s*(?:of|belonging to|belonginge to)\s*$"
HIS_PEOPLE = r"^\W*(?:his|her|their)\s+(?:people|men|servants|seruants|company|family|familie)"
SIDE_BY_SIDE = r"^[,:]?$"
OFFICE_BEFORE = rf"\b{OFFICE}\b[^;]{{0,30}}?\b(?:of|for)\s*(?:the\s+)?$"
# Between two names of a list.
LIST_LINK = r"^[,\s]*(?:and|&)?\s*(?:the\s+)?$"

#: Words before a full stop that do not end a sentence.
ABBREVIATIONS = [
    "m", "mr", "mrs", "s", "st", "sr", "sir", "capt", "cap", "captaine", "dr", "d", "lo", "kn", "knt", "esq",
    "tho", "thos", "wm", "willm", "geo", "nich", "nicho", "ed", "edw", "jo", "io", "rich", "sam", "hen",
    "fra", "chr", "nath", "rob", "robt", "ro", "jas", "ja", "ald", "viz", "vizt", "no", "nos", "&c", "etc",
    "ibid", "ma", "mat", "matie", "lp", "lps", "secr", "dep", "dpt", "gent", "co", "comp", "ea", "e",
]
