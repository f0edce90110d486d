"""Fixed values of the data model: relation types, their variants, effect types, concepts, source families."""

# Relation types, in declaration order (the order decides ties of the containment fallback).
CANONICAL_ACTIONS = [
    "AMENDS", "REPEALS", "SUBSTITUTES", "INSERTS", "COMMENCES", "REVOKES", "APPLIES", "CITES", "OVERRULES",
    "DEFINES", "INTERPRETS", "DELEGATES", "IMPLEMENTS", "CREATES", "EMPOWERS", "REQUIRES", "PROHIBITS", "EXTENDS",
]

# Accepted variants of each relation type; the last group are judicial words.
ACTION_VARIANTS = [
    ("AMENDS", ["AMEND", "AMENDED", "AMENDS", "AMENDING"]),
    ("REPEALS", ["REPEAL", "REPEALED", "REPEALS", "REPEALING", "OMIT", "OMITS", "OMITTED"]),
    ("SUBSTITUTES", ["SUBSTITUTE", "SUBSTITUTED", "SUBSTITUTES", "REPLACE", "REPLACES", "REPLACED"]),
    ("INSERTS", ["INSERT", "INSERTED", "INSERTS", "INSERTING"]),
    ("COMMENCES", ["COMMENCE", "COMMENCED", "COMMENCES"]),
    ("REVOKES", ["REVOKE", "REVOKED", "REVOKES"]),
    ("APPLIES", ["APPLY", "APPLIED", "APPLIES"]),
    ("CITES", ["CITE", "CITED", "CITES", "CITING", "REFER", "REFERS", "REFERRED", "REFERENCES", "MENTION",
        "MENTIONS", "MENTIONED", "RELATES_TO"]),
    ("OVERRULES", ["OVERRULE", "OVERRULED", "OVERRULES", "DEPART", "DEPARTS", "DEPARTED", "DISAPPROVE",
        "DISAPPROVES", "DISAPPROVED", "REVERSE", "REVERSES", "REVERSED", "QUASH", "QUASHES", "QUASHED", "SET_ASIDE"]),
    ("DEFINES", ["DEFINE", "DEFINED", "DEFINES", "DEFINING"]),
    ("INTERPRETS", ["INTERPRET", "INTERPRETED", "INTERPRETS", "CONSTRUE", "CONSTRUES", "CONSTRUED", "DISTINGUISH",
        "DISTINGUISHES", "DISTINGUISHED"]),
    ("DELEGATES", ["DELEGATE", "DELEGATED", "DELEGATES"]),
    ("IMPLEMENTS", ["IMPLEMENT", "IMPLEMENTED", "IMPLEMENTS", "TRANSPOSES", "TRANSPOSED"]),
    ("CREATES", ["CREATE", "CREATED", "CREATES", "CREATING", "ESTABLISH", "ESTABLISHES", "ESTABLISHED"]),
    ("EMPOWERS", ["EMPOWER", "EMPOWERED", "EMPOWERS", "AUTHORISE", "AUTHORISES", "AUTHORIZE", "CONFER", "CONFERS",
        "CONFERRED"]),
    ("REQUIRES", ["REQUIRE", "REQUIRED", "REQUIRES", "MANDATE", "MANDATES", "OBLIGATE", "IMPOSE", "IMPOSES"]),
    ("PROHIBITS", ["PROHIBIT", "PROHIBITED", "PROHIBITS", "RESTRICT", "RESTRICTS", "FORBID", "BAN", "BANS"]),
    ("EXTENDS", ["EXTEND", "EXTENDED", "EXTENDS", "EXTENDING", "RENEW", "RENEWS", "RENEWED", "PROLONG", "PROLONGS"]),
    ("CITES", ["FOLLOW", "FOLLOWS", "FOLLOWED", "APPROVE", "APPROVES", "APPROVED", "CONSIDER", "CONSIDERS",
        "CONSIDERED", "UPHELD", "UPHOLD", "UPHOLDS", "AFFIRM", "AFFIRMS", "AFFIRMED"]),
]
ACTION_OF = {variant: action for action, variants in ACTION_VARIANTS for variant in variants}

# Effect types of change feeds, in declaration order.
EFFECT_TYPES = [
    ("inserted", "INSERTS"), ("substituted", "SUBSTITUTES"), ("repealed", "REPEALS"), ("amended", "AMENDS"),
    ("applied", "APPLIES"), ("commenced", "COMMENCES"), ("revoked", "REVOKES"), ("extended", "EXTENDS"),
    ("words substituted", "SUBSTITUTES"), ("text amended", "AMENDS"), ("words inserted", "INSERTS"),
    ("words repealed", "REPEALS"), ("coming into force", "COMMENCES"), ("s. substituted", "SUBSTITUTES"),
    ("power to modify", "EMPOWERS"), ("applied (with modifications)", "APPLIES"), ("restricted", "PROHIBITS"),
]

# The concept taxonomy (name, description, keywords).
CONCEPTS = [
    ("Transport and Infrastructure", "Legislation covering road, rail, aviation, maritime transport, and autonomous vehicles.",
     ["transport", "road traffic", "highway", "motor vehicle", "driving", "railway", "aviation", "shipping", "tachograph",
      "traffic sign", "automated vehicle", "electric vehicle", "taxi", "pedicab", "road safety", "vehicle registration", "air traffic"]),
    ("Criminal Justice", "Legislation covering criminal law, policing, sentencing, and the courts.",
     ["criminal", "police", "offence", "court", "sentencing", "prison", "prosecution", "justice", "penalty"]),
    ("Energy and Environment", "Legislation covering energy provision, climate change, and environmental protection.",
     ["energy", "electricity", "gas", "climate", "environment", "carbon", "renewable", "nuclear", "oil", "petroleum"]),
]

# The wider, older taxonomy (name, keywords).
LEGACY_CONCEPTS = [
    ("Housing and Regeneration", ["housing", "regeneration", "planning", "dwelling", "leasehold", "rent", "landlord", "tenant"]),
    ("Employment and Labour", ["employment", "worker", "labour", "redundancy", "dismissal", "trade union", "wages", "national insurance"]),
    ("Finance and Taxation", ["finance", "tax", "taxation", "revenue", "income tax", "capital gains", "vat", "budget", "corporation", "levy", "duty", "stamp", "energy profits"]),
    ("Social Security and Welfare", ["social security", "welfare", "benefit", "universal credit", "pension", "disability", "child tax credit", "working tax credit", "jobseeker", "support allowance"]),
    ("Transport and Infrastructure", ["transport", "road", "railway", "aviation", "maritime", "vehicle", "driver", "highway", "autonomous", "self-driving", "pedicab", "taxi", "private hire"]),
    ("Energy and Environment", ["energy", "environment", "climate", "carbon", "emissions", "nuclear", "renewable", "oil", "gas", "offshore", "petroleum", "net zero"]),
    ("Building Safety and Standards", ["building", "fire safety", "construction", "structure", "regulation", "safety"]),
    ("Financial Services and Banking", ["bank", "building society", "insurance", "financial services", "pra", "fca", "prudential", "credit", "mortgage", "securities"]),
    ("Public Health and NHS", ["health", "nhs", "medical", "medicine", "mental health", "clinical", "care", "patient", "hospital", "pharmaceutical"]),
    ("Education", ["education", "school", "university", "student", "apprenticeship", "ofsted", "higher education"]),
    ("Local Government and Rates", ["local government", "council", "rates", "non-domestic", "authority", "municipality", "unitary", "combined authority"]),
    ("Criminal Justice and Policing", ["criminal", "police", "offence", "court", "sentencing", "prison", "prosecution", "justice", "penalty"]),
    ("Immigration and Asylum", ["immigration", "asylum", "nationality", "visa", "border", "migration", "refugee"]),
    ("Data Protection and Digital", ["data protection", "digital", "cyber", "online", "internet", "gdpr", "privacy", "information"]),
    ("Intellectual Property", ["intellectual property", "patent", "trademark", "copyright", "trade secret", "design right"]),
    ("Agriculture and Food", ["agriculture", "farm", "food", "fisheries", "rural", "livestock", "crop"]),
    ("Competition and Consumer", ["competition", "consumer", "market", "monopoly", "merger", "antitrust", "unfair"]),
    ("Constitutional and Administrative", ["constitutional", "devolution", "parliament", "prerogative", "public administration", "westminster", "statutory instrument", "subordinate legislation"]),
]

# Document types of each family, courts, and the discovery vocabulary.
ACT_TYPES = ["ukpga", "asp", "anaw", "mwa", "nia", "ukcm"]
INSTRUMENT_TYPES = ["uksi", "ssi", "wsi", "nisr", "ukmo", "ukmd"]
CASE_MARKS = ["uksc_", "ewca_", "ewhc_", "ukut_"]
COURTS = [("uksc", "Supreme Court"), ("ewca", "Court of Appeal"), ("ewhc", "High Court")]
ENUMERATED_TYPES = ["uksi", "wsi", "ssi", "nisr"]
ENUMERATED_YEARS = range(1988, 2025)
TITLE_PATTERN = (
    r"(?i)transport|road\s*traffic|highway|motor\s*vehicle|driving|railway|aviation|shipping|tachograph|traffic\s*sign"
    r"|vehicle\s*licen|automated\s*vehicle|electric\s*vehicle|taxis|pedicab"
)
SUBJECTS = [
    "transport", "road-traffic", "road-safety", "highways", "motor-vehicles", "driving-licences", "railways", "aviation",
    "shipping", "public-transport", "vehicle-excise", "traffic-regulation", "tachographs",
]
TITLE_KEYWORDS = [
    "transport act", "road traffic", "road safety", "highways act", "motor vehicles", "driving licences", "traffic signs",
    "traffic regulation", "railways act", "civil aviation", "air traffic", "unmanned aircraft", "automated vehicles",
    "electric vehicles", "taxis", "private hire vehicles", "goods vehicles", "vehicle registration", "tachograph",
    "pedicabs", "shipping act",
]
