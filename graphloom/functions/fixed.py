"""Word lists, patterns and constants that define the results."""

# Fixed values.
ENTITY_SUFFIXES = ["inc", "incorporated", "corp", "corporation", "llc", "ltd", "limited", "plc", "company", "gmbh", "ag", "sa", "lp", "llp"]

US_STATES = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia",
    "hawaii", "idaho", "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maine", "maryland",
    "massachusetts", "michigan", "minnesota", "mississippi", "missouri", "montana", "nebraska", "nevada", "new hampshire",
    "new jersey", "new mexico", "new york", "north carolina", "north dakota", "ohio", "oklahoma", "oregon",
    "pennsylvania", "rhode island", "south carolina", "south dakota", "tennessee", "texas", "utah", "vermont",
    "virginia", "washington", "west virginia", "wisconsin", "wyoming",
]

KNOWN_JURISDICTIONS = [
    "alabama", "alaska", "arizona", "arkansas", "california", "colorado", "connecticut", "delaware", "florida", "georgia",
    "illinois", "indiana", "iowa", "kansas", "kentucky", "louisiana", "maryland", "massachusetts", "michigan",
    "minnesota", "missouri", "nevada", "new jersey", "new york", "north carolina", "ohio", "oregon", "pennsylvania",
    "tennessee", "texas", "utah", "virginia", "washington", "wisconsin", "england", "bermuda", "canada", "china",
    "germany", "france", "ireland", "israel",
]

MONTHS = (
    r"January|February|March|April|May|June|July|August|September|October|November|December|"
    r"Jan\.?|Feb\.?|Mar\.?|Apr\.?|Jun\.?|Jul\.?|Aug\.?|Sep\.?|Sept\.?|Oct\.?|Nov\.?|Dec\.?"
)
LONG_DATE = rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}},?\s+\d{{4}}\b"
ANY_DATE = rf"(?i)\b(?:{MONTHS})\s+\d{{1,2}}(?:,?\s+\d{{4}})?\b|\b\d{{1,2}}[/-]\d{{1,2}}[/-]\d{{2,4}}\b"
ORGANISATION = (
    r"\b[A-Z][A-Za-z0-9&'\-]*(?:\s+[A-Z][A-Za-z0-9&'\-]*){0,8}\s+"
    r"(?:Inc\.?|Incorporated|Corp\.?|Corporation|LLC|Ltd\.?|Limited|PLC|Company|LP|LLP)\b"
)
CONTRACT_HINT = r"\b([A-Z][A-Z0-9&,\- ]{4,90}\s+(?:AGREEMENT|CONTRACT|LICENSE|AMENDMENT|LEASE|ORDER|STATEMENT OF WORK))\b"
JURISDICTION_HINT = (
    r"(?i)\b(?:laws of|state of|province of|located in|located at|principal place of business (?:at|in))\s+"
    r"([A-Z][A-Za-z ]{3,40}?)(?:,|\.|\)|;|\band\b|\bwith\b|\s+\d|$)"
)
JURISDICTION_NEAR = (
    r"(?i)\b(?:laws of|state of|province of|jurisdiction of|organized under|incorporated under|located in|located at)\s+"
    r"([A-Z][A-Za-z ]{2,40}?)(?:,|\.|\)|;|\band\b|\bwith\b|\s+\d|$)"
)
TITLE = r"(?i)([A-Za-z ,&'\-]+ Agreement|Contract|License)"
CONTRACT_TITLE_NEAR = r"(?i)\b([A-Z][A-Za-z0-9&,'\- ]{0,80}?(?:Agreement|Contract|License|Lease|Amendment|Order|Statement of Work))\b"
STRONG_CONTRACT = r"(?i)\b(?:agreement|contract|license|lease|amendment|order|statement of work|sow|mou|memorandum of understanding)\b"
BOILERPLATE = r"(?i)\b(?:below|above|herein|hereof|hereto|hereunder|witnesseth|pursuant|notwithstanding|whereas|shall|hereby)\b"
LEGAL_KEYWORD = r"(?i)\b(?:agreement|contract|inc|corp|llc|ltd|company|effective|date)\b"
MODAL = r"(?i)\b(?:shall|may|must|will|agreement|section)\b"
LEGAL_SUFFIX = r"incorporated|corporation|corp|company|co|limited liability company|llc|l\.l\.c|limited|ltd|l\.p|lp|llp|plc|inc"

PRONOUN_ARTIFACTS = ["this", "that", "it", "these", "those", "such", "same", "which", "who", "whom", "herein", "hereof", "hereto", "hereunder"]

DOMAIN_RANGE = {
    "PARTY_OF": [("PARTY", "CONTRACT")],
    "ENTERED_INTO": [("PARTY", "CONTRACT"), ("CONTRACT", "PARTY")],
    "EFFECTIVE_ON": [("CONTRACT", "EFFECTIVE_DATE"), ("CONTRACT", "DATE")],
    "GOVERNED_BY": [("CONTRACT", "JURISDICTION"), ("PARTY", "JURISDICTION")],
    "LOCATED_IN": [("PARTY", "JURISDICTION")],
    "ORGANIZED_UNDER": [("PARTY", "JURISDICTION")],
}
OBJECT_PRIORS = {
    "GOVERNED_BY": ["JURISDICTION"],
    "LOCATED_IN": ["JURISDICTION"],
    "ORGANIZED_UNDER": ["JURISDICTION"],
    "EFFECTIVE_ON": ["DATE", "EFFECTIVE_DATE"],
}
FANOUT_CAPS = {"EFFECTIVE_ON": 1, "ORGANIZED_UNDER": 1, "GOVERNED_BY": 1, "LOCATED_IN": 1}

PREDICATES = [
    ("ENTERED_INTO", ["entered into", "enter into", "executes", "execute", "execution", "executed"]),
    ("GOVERNED_BY", ["governed by", "construed by", "governed and construed", "promulgated under", "promulgated", "pursuant to"]),
    ("PAYABLE_BY", ["agrees to pay", "agreed to pay", "shall pay", "will pay", "payable to"]),
    ("GRANTED_TO", ["grants to", "granted to", "grant to", "license to", "licenses to"]),
    ("EFFECTIVE_ON", ["effective as of", "effective date", "dated as of", "commencing on", "dated as", "dated"]),
    ("PARTY_OF", ["party to", "parties to", "is a party", "are parties", "by and between", "between"]),
    ("APPOINTED_AS", ["appoints", "appointed as", "appoint"]),
    ("SUBJECT_TO", ["subject to", "conditioned on", "contingent on"]),
    ("LIMITED_TO", ["limited to", "restricted to", "shall not exceed"]),
    ("DEFINED_IN", ["defined in", "as defined", "meaning set forth"]),
    ("TERMINATES", ["terminates", "terminate", "termination of"]),
    ("OWNS", ["owns", "shall own", "retains ownership"]),
    ("LOCATED_IN", ["located at", "located in", "headquartered at", "headquartered in", "situated at", "situated in"]),
    ("ORGANIZED_UNDER", ["organized under", "organized in", "incorporated under", "incorporated in"]),
    ("REFERRED_TO_AS", ["referred to as", "hereinafter referred to as", "known as"]),
    ("IS_A", ["is", "are", "was", "were"]),
    ("HAS", ["has", "have", "had", "having", "holding", "holds"]),
    ("CONTAINS", ["contains", "contained in", "included in"]),
    ("REQUESTED_BY", ["requested", "requested with", "requesting"]),
    ("INDICATED_BY", ["indicated by", "indicated"]),
]
GARBAGE_PREDICATES = [
    "definitions", "omitted", "exhibit", "outsourcing", "pages", "making", "identified", "contracted", "definitions as",
    "contained in by", "requested with", "and", "or", "the", "a", "an", "to", "of", "in", "on", "by", "for",
]

RELATION_HINTS = {
    "governing law": ["governed_by", "governing_law", "jurisdiction"],
    "jurisdiction": ["jurisdiction", "governed_by"],
    "effective date": ["effective_date", "commences", "start_date"],
    "notice": ["notice_address", "notice_to"],
    "distributor": ["distributor_of", "distributed_by", "distributes"],
    "parent company": ["parent_of", "subsidiary_of", "owns", "owned_by"],
    "subsidiary": ["subsidiary_of", "parent_of"],
    "terminat": ["terminates", "termination_of", "terminated_by"],
    "govern": ["governed_by", "governing_law"],
}
EXAMPLES = {
    "PARTY": "Who is {}",
    "CONTRACT": "What does the {} cover",
    "JURISDICTION": "Which contracts are governed by {}",
    "DATE": "What happens on {}",
    "EFFECTIVE_DATE": "What is effective on {}",
    "NOTICE": "Where should notice be sent",
}
QUERY_STOP_WORDS = [
    "the", "a", "an", "this", "that", "these", "those", "it", "its", "you", "your", "we", "our", "they", "their", "he",
    "she", "his", "her", "is", "are", "was", "were", "be", "been", "being", "and", "or", "but", "of", "in", "on", "at",
    "to", "for", "with", "as", "by", "from", "which", "who", "whom", "such", "any", "all", "here", "there",
]
GENERIC_ROLES = [
    "company", "distributor", "vendor", "client", "party", "parties", "purchaser", "seller", "licensor", "licensee",
    "contractor", "agreement", "supplier", "customer", "buyer", "manufacturer", "the company", "the distributor",
    "the vendor", "the client", "the agreement",
]
GAZETTEERS = {
    "is_company_suffix": ["llc", "inc", "corp", "ltd", "plc", "gmbh", "ag", "sa", "corporation", "incorporated", "limited", "company", "co", "group", "holdings", "partners", "associates", "ventures"],
    "is_jurisdiction": ["delaware", "california", "york", "texas", "florida", "illinois", "nevada", "england", "wales", "ontario", "germany", "france", "china", "india", "israel", "pennsylvania", "kansas", "massachusetts", "virginia", "georgia", "ohio"],
    "is_month": ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"],
    "is_legal_term": ["agreement", "contract", "license", "arrangement", "deed", "indenture", "amendment", "addendum", "exhibit", "schedule", "annex", "attachment", "appendix"],
    "is_notice_term": ["notice", "notification", "written notice", "prior notice", "advance notice", "formal notice"],
    "is_date_indicator": ["dated", "effective", "executed", "entered", "signed", "commencing", "expiring", "terminating"],
}
OBJECT_TYPES = {"GOVERNED_BY": ["JURISDICTION"], "LOCATED_IN": ["JURISDICTION"], "ORGANIZED_UNDER": ["JURISDICTION"], "EFFECTIVE_ON": ["DATE", "EFFECTIVE_DATE"]}
CURRENCY, SECTIONS = ["usd", "dollars"], ["section", "article", "clause", "exhibit"]
ER_WEIGHTS = {"char_sim": 2.4, "token_jaccard": 2.0, "acronym_match": 1.5, "same_file": 0.4, "len_ratio": 0.7}
ER_BIAS, ER_THRESHOLD = -3.1, 0.72
BM25_K1, BM25_B, BM25_EPSILON = 1.5, 0.75, 0.25
RRF_K, GRAPH_BOOST = 60, 0.35
AUXILIARIES = "am is are was were be been being has have had do does did will would shall should may might must can could".split()
ADVERBS = "not also hereby thereby duly fully then now".split()
PREPOSITIONS = "of in to for with on at by from into under between among upon within without against through over after before about as per out off up down".split()
VERBS = (
    "accept acquire act agree amend apply appoint approve assign become begin bind bring buy call cause come commence comply comprise constitute contain continue control cover create date define deliver depend describe designate develop "
    "distribute enter establish exceed execute exercise expire file follow form furnish give go govern grant hold include indemnify incorporate issue keep lease license limit locate maintain make manage mean notify obtain occur offer operate order "
    "own pay perform permit place prepare produce promote protect provide purchase receive refer relate release remain renew rent report represent require reserve retain return sell send serve set sign specify start state submit supply take terminate transfer use work write"
).split()
IRREGULAR_VERBS = "made held bought brought sold sent paid given gone kept taken begun began bound written wrote chosen known found built left lent met understood undertaken".split()
# End of the fixed values.
