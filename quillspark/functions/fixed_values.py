"""Word lists, patterns, tables and formats that results must agree on. All can be replaced by parameters."""

# Categories in order of preference, and their keywords.
CATEGORIES = {
    "housing_repairs": ["mould", "damp", "repair", "leak", "broken", "heating", "boiler"],
    "council_tax": ["council tax", "benefit", "hardship", "payment", "arrears", "discount"],
    "parking": ["parking", "fine", "PCN", "permit", "ticket", "appeal", "vehicle"],
    "complaint": ["complaint", "appeal", "unhappy", "dissatisfied", "service"],
    "waste": ["waste", "fly-tipping", "bin", "rubbish", "noise", "collection"],
    "adult_social_care": ["adult", "elderly", "care", "disability", "support", "carer"],
    "children_safeguarding": ["child", "safeguarding", "abuse", "neglect", "concern", "vulnerable"],
    "foi_legal": ["FOI", "SAR", "freedom of information", "subject access", "legal", "GDPR"],
    "translation": ["translate", "language", "interpreter", "non-english"],
}
DEPARTMENTS = {
    "housing_repairs": "Housing & Property Services",
    "council_tax": "Revenue & Benefits",
    "parking": "Parking Services",
    "complaint": "Customer Relations / Complaints",
    "waste": "Environmental Services",
    "adult_social_care": "Adult Social Care",
    "children_safeguarding": "Children's Services / Safeguarding",
    "foi_legal": "Legal & Governance",
    "translation": "Customer Services / Translation Hub",
    "unknown": "General Enquiries",
}
URGENCY_BASE = {
    "housing_repairs": 0.5, "council_tax": 0.4, "parking": 0.3, "complaint": 0.4, "waste": 0.3,
    "adult_social_care": 0.7, "children_safeguarding": 1.0, "foi_legal": 0.3, "translation": 0.2, "unknown": 0.2,
}
RISK_KEYWORDS = {
    "safeguarding": ["abuse", "neglect", "unsafe", "hurt", "scared"],
    "distress": ["suicide", "self-harm", "depression", "desperate", "nowhere"],
    "financial_hardship": ["can't pay", "starving", "eviction", "homeless", "no money"],
    "angry": ["disgusting", "unacceptable", "useless", "terrible", "furious"],
    "unsafe_housing": ["mould", "damp", "cold", "no heating", "rat", "infestation"],
    "repeated_complaint": ["again", "before", "still", "nothing done", "ignored"],
}
NEGATIVE_WORDS = ["unhappy", "dissatisfied", "terrible", "awful", "bad", "poor", "disgusting", "useless", "furious", "angry", "worried", "scared", "desperate"]
POSITIVE_WORDS = ["happy", "satisfied", "good", "excellent", "thank", "grateful", "pleased"]
DISTRESS_WORDS = ["suicide", "self-harm", "depression", "desperate", "nowhere", "hopeless"]
ANGRY_WORDS = ["disgusting", "unacceptable", "useless", "terrible", "furious", "angry", "outrage"]
CONFIDENCE_THRESHOLD = 0.6

# Structured personal data: pattern, confidence. Tried in this order.
STRUCTURED = {
    "email": (r"(?i)[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}", 0.90),
    "phone": (r"(?:\+44\s?\(?0\)?[\s\-]?)?(?:\(0\)[\s\-]?)?[1-9][0-9]{0,4}[\s\-]?[0-9\s\-]{6,10}(?![0-9])", 0.88),
    "postcode": (r"(?i)[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2}", 0.88),
    "dob": (
        r"(?:\b(?:0?[1-9]|[12][0-9]|3[01])[/-](?:0?[1-9]|1[0-2])[/-](?:19|20)?\d{2}\b)"
        r"|(?:\b(?:0?[1-9]|1[0-2])[/-](?:0?[1-9]|[12][0-9]|3[01])[/-](?:19|20)?\d{2}\b)",
        0.88,
    ),
    "nin": (r"(?i)(?:[A-CEGHJ-PR-TW-Z]{1}[A-CEGHJ-NPR-TW-Z]{1}\s?\d{6}\s?[A-DFM]{1})|(?:[A-CEGHJ-PR-TW-Z]{1}\s?\d{6}\s?[A-DFM]{1})", 0.90),
    "bank_account": (r"(?:\b\d{8}\b)\s*(?:sort\s*code[\s:]*\d{2}[-\s]?\d{2}[-\s]?\d{2})?|(?:\d{2}[-\s]?\d{2}[-\s]?\d{2}\s*\d{8})", 0.90),
    "vehicle_reg": (r"(?i)(?:[A-Z]{2}\s?\d{2}\s?[A-Z]{3})|(?:[A-Z]{1,3}\s?\d{1,4}\s?[A-Z]{1,3})|(?:\d{1,4}\s?[A-Z]{1,3}\s?\d{1,2})", 0.85),
    "council_ref": (r"(?i)\bREF-?\d{5,8}\b", 0.80),
}
MONTH = r"(?i)\b(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)\b"

# Identifiers of the second detector.
IDENTIFIERS = {
    "nhs_number": r"\b(?:\d{3}\s*[-\s]?\d{3}\s*[-\s]?\d{4})\b|\b(?:\d{10})\b",
    "nin": r"(?i)\b(?:[A-CEGHJ-PR-TW-Z]{1}[A-CEGHJ-NPR-TW-Z]{1}\s?\d{6}\s?[A-DFM]{1})\b",
    "utr": r"\b(?:\d{10})\b",
    "driving_licence": r"(?i)\b(?:[A-Z9]{5}\d{6}[A-Z9]{2}\d[A-Z]{2})\b",
    "council_tax_ref": r"(?i)\b(?:CT\d{6,10})\b",
    "pcn_number": r"(?i)\b(?:PCN\s?\d{6,10})\b",
    "passport_number": r"\b(?:\d{9})\b",
}
IDENTIFIER_POSTCODE = r"(?i)\b(?:[A-Z]{1,2}[0-9][A-Z0-9]?\s*[0-9][A-Z]{2})\b"
NIN_FIRST, NIN_SECOND, NIN_BANNED, NIN_LAST = "ABCDEFGHJKLMNOPRSTWXYZ", "ABCEGHJKLMNOPRSTWXYZ", ["BG", "GB", "KN", "NK", "NT", "TN", "ZZ"], "ABCD"

# Labels of form fields; the value stands behind the match. Tried in this order.
LABELS = {
    "person_name": r"(?<!\w)(?:Requester\s+Name|Full\s+Name|Patient\s+Name|Child(?:'?s)?\s+Name|Applicant(?:\s+Name)?|Nombre|Reported\s+by|Emergency\s+Contact|Carer(?:\s+Name)?|Parent|Name)\b\s*[:\-=]\s*",
    "dob": r"(?<!\w)(?:D\.?O\.?B\.?|Date\s+of\s+Birth|Born)\b(?:\s*[:\-=]\s*|\s+)",
    "address": r"(?<!\w)(?<!Email\s)(?:(?:Home\s+|Property\s+|Contact\s+)?Address|Direcci[oó]n)\b(?:\s*[:\-=]\s*|\s+)",
    "phone": r"(?<!\w)(?:Emergency\s+Phone|Emergency\s+Tel(?:ephone)?|Mobile|Telephone|Tel[eé]fono|Contact\s+Number|Phone\s*Number|Phone)\b(?:\s*[:\-=]\s*|\s+)",
    "email": r"(?<!\w)Email(?:\s+Address)?\b\s*[:\-=]\s*",
    "nin": r"(?<!\w)(?:N\.?I\.?\s*(?:Number)?|NIN|National\s+Insurance(?:\s+Number)?|National\s+ID)\b(?:\s*[:\-=]\s*|\s+)",
    "nhs_number": r"(?<!\w)(?:NHS|N\.?H\.?S\.?|N\s*[HM]\s*S|NMS)\s*(?:Number)?\b(?:\s*[:\-=]\s*|\s+)",
    "bank_details": r"(?:Bank\s+Account|Account\s+Number|Sort\s+Code)\s*[:\-]?\s+",
    "pcn": r"PCN\s*[:\-]?\s+",
    "vehicle_reg": r"(?:Vehicle\s+Reg(?:istration)?|VRM|Registration)\s*[:\-]?\s+",
    "council_ref": r"(?<!\w)(?:Council\s+Reference|Council\s+Ref|Case\s+Reference|Case\s+Ref|Reference|Ref|Counc\W+reference)\b\s*[:\-=]\s*",
    "school": r"(?:^|\n)\s*School\s*[:\-]?\s+",
    "signature": r"Signature\s*[:\-]?\s+",
    "notes": r"(?:^|\n)\s*Notes\s*[:\-]?\s+",
}
LABEL_VALUE_MAX = {"address": 200, "notes": 300, "signature": 80, "nin": 25, "phone": 20, "vehicle_reg": 10, "pcn": 22, "school": 90, "nhs_number": 20, "council_ref": 40}
LABEL_VALUE_DEFAULT_MAX = 60
# Labels that end a value and begin none.
BOUNDARIES = [
    r"Date\s*[:\-]?\s+", r"Reference\s*[:\-]?\s+", r"Ref(?:erence)?\s*No\s*[:\-]?\s+", r"Request\s*[:\-]?\s+", r"Solicitud\s*[:\-]?\s+",
    r"Fecha\s*[:\-]?\s+", r"Nom\s*[:\-]?\s+", r"Adresse\s*[:\-]?\s+", r"Location\s*[:\-]?\s+", r"Issue\s*[:\-]?\s+",
    r"Repair\s+type\s*[:\-]?\s+", r"Appeal\s+reason\s*[:\-]?\s+", r"Complaint\s*[:\-]?\s+", r"Comments\s*[:\-]?\s+", r"Description\s*[:\-]?\s+",
    r"Medication\s+list\s*[:\-]?\s+", r"Payment\s+date\s*[:\-]?\s+", r"Deadline\s+date\s*[:\-]?\s+", r"Public\s+authority\s*[:\-]?\s+", r"Occupation\s*[:\-]?\s+",
    r"Job\s+Title\s*[:\-]?\s+", r"Employer\s*[:\-]?\s+", r"Gender\s*[:\-]?\s+", r"Case\s+Worker\s*[:\-]?\s+", r"Case\s+(?:No|Number|Ref)\s*[:\-]?\s+",
    r"GP\s+(?:Name|Doctor)?\s*[:\-]?\s+", r"Doctor\s*[:\-]?\s+", r"Status\s*[:\-]?\s+", r"Type\s*[:\-]?\s+", r"Fax\s*[:\-]?\s+",
    r"Tel\s*[:\-]?\s+", r"Re\s*[:\-]?\s+", r"Department\s*[:\-]?\s+", r"Sincerely\s*[,\s]+", r"Dear\s+",
]

# Sentences on health: a term and a reference to a patient.
MEDICAL_TERMS = (
    r"\b(?:asthma|an[ae]mia|migraine|diabetes|hypertension|arthritis|depression|anxiety|cancer|tumou?r|fracture|infection|disorder|syndrome|condition|disability|"
    r"COPD|epilepsy|dementia|schizophrenia|bipolar|stroke|fibrosis|shortness\s+of\s+breath|fatigue|nausea|dizziness|headache|insomnia|"
    r"sleep\s+disruption|intermittent|symptomatic|pain|vomiting|vertigo|palpitation|seizure|tremor|swelling|inflammation|"
    r"corticosteroid|supplementation|medication|prescription|inhaler|tablet|dose|dosage|prescribed|treatment|therapy|surgery|procedure|injection|"
    r"antibiotic|antidepressant|analgesic|painkiller|chemotherapy|diagnosis|prognosis|medical\s+history|documented|under\s+our\s+care|"
    r"follow.?up|periodic|appointment|lifestyle\s+recommendation|clinical|hospital(?:ised|ized)|admitted|discharge|referral|"
    r"safeguarding|abuse|neglect|vulnerable|concern|at\s+risk|self.harm|domestic\s+violence|care\s+plan|social\s+worker|case\s+note)\b"
)
PATIENT_REFERENCE = (
    r"\b(?:the\s+patient|patient\s+(?:has|had|is|was|reported|may|requires?|needs?)|she\s+(?:has|had|is|was|reported|requires?)|"
    r"he\s+(?:has|had|is|was|reported|requires?)|her\s+(?:condition|medical|health|symptoms?|diagnos)|his\s+(?:condition|medical|health|symptoms?|diagnos)|"
    r"confirms?\s+that\s+(?:the\s+)?(?:Ms|Mr|Mrs)\.?\s+\w+|(?:Ms|Mr|Mrs)\.?\s+\w+\s+(?:has|is|was|had|reported)|this\s+letter\s+confirms)\b"
)
HARDSHIP = r"\b(?:cannot\s+afford|can't\s+afford|no\s+money|food\s+bank|homeless|eviction|starving|desperate|unsafe\s+at\s+home|feels\s+unsafe)\b"
ADDRESS_LINE = r"\b(?:flat|room|house|road|rd|street|st|avenue|ave|lane|ln|drive|close|court|crescent|gardens|way|place|terrace|demo)\b"
ADDRESS_PHRASE = r"\bI\s+live\s+at\s+(.+?)(?=\.|\n|$)"
HEADER_STOP = r"^(?:date|dear|to\s+the|parking\s+appeal|safeguarding|council\s+tax)\b"
CONTACT_LINE = r"^(?:email|phone|mobile|tel|telephone)\b"
GENERIC_LABEL_LINE = r"^\s*[A-Za-zÀ-ÖØ-öø-ÿ][A-Za-zÀ-ÖØ-öø-ÿ' /-]{1,40}\s*[:=]\s*\S+"
SIGN_OFF = r"^(?:yours\s+(?:faithfully|sincerely)|kind\s+regards|regards|sincerely|signed)\b"
TITLED_NAME = r"\b(?:Mr\.?|Mrs\.?|Ms\.?|Miss|Sir|Dr\.?|Prof\.?|Lord|Lady|Rev\.?|Capt\.?|Major|Colonel|General|Dame)\s+(?:[A-Z][a-zA-Z\-']{1,15}(?:\s+[A-Z][a-zA-Z\-']{1,15}){0,2})"
TITLE_CONTEXT = r"(?:^|(?:dear|re|regarding|patient|applicant|requester|child|parent|carer|reported\s+by|full\s+name|name)\s*[:,-]?\s*)$"
RELATION = r"(?:my|our|the)\s+(?:son|daughter|child|children|stepson|stepdaughter|foster\s+child|grandson|granddaughter)"
DEPENDENT_NAME = r"\b(?i:" + RELATION + r"\s*,?\s+)([A-Z][a-zA-Z'-]{1,24}(?:\s+[A-Z][a-zA-Z'-]{1,24}){1,2})(?=\s*(?:[,.;:]|[-_=]*\s*(?:age|aged|is|has|had|was|who)\b|$))"
DEPENDENT_AGE = r"\b(?i:" + RELATION + r")\b.{0,90}?(\bage[d]?\s*[,;:]?\s*(?:\d{1,2}|[Il])\b)"
DEPENDENT_STOP = ["age", "aged", "has", "had", "is", "was", "were", "who", "with", "asthma", "breathing", "medical", "condition", "son", "daughter", "child", "children"]
NOT_NAMES = [
    "The", "From", "Date", "Subject", "Regarding", "Dear", "Yours", "Sincerely", "Regards", "Council", "Hillingdon", "London",
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday",
    "January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December",
]

# Which types a profile redacts, which profiles a category has, and what always needs review.
PROFILES = {
    "general_pii": ["person_name", "address", "phone", "email", "dob", "postcode", "signature", "council_ref", "nin", "child_age"],
    "medical_strict": ["person_name", "address", "phone", "email", "dob", "postcode", "nin", "nhs_number", "signature", "medical_details", "notes", "child_age"],
    "financial_strict": ["nin", "bank_account", "bank_details", "sort_code", "council_ref", "benefit_ref", "notes"],
    "safeguarding_strict": ["person_name", "address", "phone", "email", "dob", "postcode", "nin", "school", "signature", "case_ref", "medical_details", "notes", "child_age"],
    "vehicle_parking": ["vehicle_reg", "pcn", "person_name", "address", "phone", "email"],
    "unknown_strict": ["person_name", "address", "phone", "email", "dob", "postcode", "nin", "signature", "council_ref", "notes", "bank_details", "medical_details", "child_age"],
}
CATEGORY_PROFILES = {
    "housing_repairs": ["general_pii"],
    "complaint": ["general_pii"],
    "waste": ["general_pii"],
    "council_tax": ["general_pii", "financial_strict"],
    "parking": ["general_pii", "vehicle_parking"],
    "adult_social_care": ["general_pii", "medical_strict"],
    "children_safeguarding": ["general_pii", "safeguarding_strict", "medical_strict"],
    "foi_legal": ["general_pii"],
    "translation": ["general_pii"],
    "unknown": ["unknown_strict"],
}
REVIEW_CATEGORIES, REVIEW_PROFILES = ["foi_legal", "unknown"], ["safeguarding_strict"]

# What a role sees of a type: none (as it is), partial (masked), full (redacted).
ROLES = {
    "caseworker": {"phone": "partial", "email": "partial", "address": "partial", "person_name": "none", "nin": "full", "nhs_number": "full", "bank_account": "full", "dob": "full", "postcode": "none", "default": "full"},
    "public_facing": {"default": "full"},
    "auditor": {"default": "none"},
    "admin": {"default": "none"},
    "processor": {"default": "full"},
}
DEFAULT_ROLE = "processor"

STATUS_PERCENT = {
    "uploaded": 5, "preprocessing": 15, "ocr": 30, "redaction": 50, "translation": 60, "classification": 75, "routing": 85,
    "complete": 100, "needs_review": 100, "in_review": 100, "review_approved": 100, "error": 100, "failed": 100,
}
TERMINAL_STATUS = ["complete", "needs_review", "review_approved", "error", "failed"]
FIELD_TYPES = {
    "name": "person_name", "full_name": "person_name", "patient_name": "person_name", "child_name": "person_name", "national_id": "nin",
    "national_insurance": "nin", "nhs_number": "nhs_number", "bank": "bank_details", "sort_code": "bank_details", "pcn": "pcn", "school": "school",
    "reference": "council_ref", "ref": "council_ref", "medical": "medical_details", "allergy": "medical_details",
}
TYPE_ALIASES = {"nhs_number": "nin", "pcn": "vehicle_reg"}
# Labels of token classifiers and the types they mean, and how sure a fallback entity is.
MODEL_LABELS = {"PER": "person_name", "ORG": "organization", "LOC": "location", "MISC": "misc"}
FALLBACK_ENTITIES = {"PERSON": 0.70, "GPE": 0.65, "ORG": 0.65, "LOC": 0.65}
# Types that are told apart well enough to be looked for on a whole page; the largest share of a page that an unsure box may cover.
DISTINCTIVE_TYPES = ["reference", "case_reference", "email", "phone", "postcode"]
UNSURE_AREA = 0.06
# Words that close a letter.
CLOSING_WORDS = ["sign", "signed", "regards", "faithfully", "sincerely"]
