"""Fixed values.

Word lists, patterns, weights and limits that decide results. They are stated
as plain text and are used by every operator that needs them. Patterns keep to
the syntax Java and RE2 share (no look-around, no back-reference).
"""

NOT_FOUND = "Not Found"
ENGINE_VERSION = "1.0.0"
AS_OF = "2001-08-02 00:00:00"

# ---------------------------------------------------------------- fixed values
# Files: extension -> MIME type, magic bytes (hex prefix at offset) -> type.
EXTENSION_MIME = {
    ".pdf": "application/pdf",
    ".doc": "application/msword",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".jpg": "image/jpeg",
    ".jpeg": "image/jpeg",
    ".png": "image/png",
    ".webp": "image/webp",
}
SUPPORTED_MIMES = list(dict.fromkeys(EXTENSION_MIME.values()))
MAGIC = [  # (offset, hex prefix, type)
    (0, "25504446", "application/pdf"),
    (0, "D0CF11E0A1B11AE1", "application/x-cfb"),
    (0, "504B0304", "application/zip"),
    (0, "FFD8FF", "image/jpeg"),
    (0, "89504E470D0A1A0A", "image/png"),
    (8, "57454250", "image/webp"),
]
HOSTED_DOC_MIME = "application/vnd.google-apps.document"
FOLDER_MIME = "application/vnd.google-apps.folder"
UNSAFE_NAME_CHARS = r'[\x00-\x1f<>:"/\\|?*]'
MAX_NAME_CHARS = 200
SLUG_CHARS = 48

# ---------------------------------------------------------------- fixed values
# Document structure.
SECTIONS = [
    ("objective", r"(?i)^(career\s+)?(objective|career\s+goal|professional\s+objective|job\s+objective)s?$"),
    ("summary", r"(?i)^(professional\s+)?(summary|profile|about\s+me|profile\s+summary|executive\s+summary|career\s+summary|synopsis|overview|resume\s+headline|headline)$"),
    ("personal_details", r"(?i)^(personal\s+(details|information|profile|data)|bio\s*-?\s*data|candidate\s+details)$"),
    ("experience", r"(?i)^(work\s+)?(experience|employment(\s+history)?|professional\s+experience|work\s+history|career\s+history|職務|internships?)$"),
    ("education", r"(?i)^(education(al)?(\s+qualification(s)?)?|academic(\s+(qualification|record|details))?s?|qualifications?)$"),
    ("skills", r"(?i)^((technical|key|core|professional|it)\s+)?(skills?|competenc(y|ies)|expertise|technologies|tech\s+stack)$"),
    ("projects", r"(?i)^(projects?|academic\s+projects?|major\s+projects?|project\s+(details|work|experience))$"),
    ("certifications", r"(?i)^(certifications?|courses?|training|achievements?|awards?|accomplishments?)$"),
    ("references", r"(?i)^(references?|referees?|reference\s+details)$"),
    ("declaration", r"(?i)^(declaration|i\s+hereby\s+declare)"),
]
HEADING_CHARS = 45
HEADER_LINES = 18
LEAD_MARKS = r"^[\s*#|>~=_·•▪◦\-–—]+"
TRAIL_MARKS = r"[\s*#|<~=_·•▪◦\-–—:]+$"
LIST_NUMBER = r"^\d+[.)]\s*"
LABEL_LINE = r"^\s*([A-Za-z][A-Za-z /&.'()-]{1,40}?)\s*[:\-–—]\s*(.+?)\s*$"
BARE_LABEL_LINE = (
    r"(?i)^\s*((?:candidate\s+name|full\s+name|father'?s?\s+name|name|mobile(?:\s+no\.?)?|phone(?:\s+no\.?)?"
    r"|contact(?:\s+no\.?)?|tele?phone|email(?:\s+id)?|e-?mail|position\s+applied(?:\s+for)?"
    r"|post\s+applied(?:\s+for)?|applied\s+for|job\s+role|designation|current\s+designation|date\s+of\s+birth|dob"
    r"|address|nationality|gender|marital\s+status|languages?\s+known|qualification)\s+)(\S.*?)\s*$"
)
EMAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
URL = r"(?i)\b(?:https?://|www\.)[^\s,;]+"

# ---------------------------------------------------------------- fixed values
# Phone numbers.
PHONE_RUN = r"(?:\+?\d{1,3}[\s.-]?)?(?:\(\d{2,5}\)[\s.-]?)?\d[\d\s.-]{5,17}\d"
PHONE_MENTION = r"(?:\+?\d{1,3}[\s-]?)?(?:\(\d{2,5}\)[\s-]?)?\d[\d\s-]{7,13}\d"
OWN_PHONE_LABEL = r"(?i)\b(mobile|mob|cell|phone|contact|contact\s*(no|number)|ph|tel|telephone|whatsapp|personal\s*(no|number|contact))\b"
FOREIGN_PHONE_LABEL = r"(?i)\b(alternate|alternative|secondary|office|work|landline|residence|residential|home|emergency|father|mother|guardian|spouse|parent|company|employer|hr|reference|referee|fax)\b"
THIRD_PARTY_LINE = r"\b(?:[Mm]rs?|[Mm]s|[Mm]iss|[Dd]r|[Pp]rof|[Ss]hri|[Ss]mt)\.?\s+[\p{Lu}][\p{L}'-]+(?:\s+[\p{Lu}][\p{L}'-]+)?\s*[,-]\s*[^,]{2,40}"
NON_PHONE_CONTEXT = r"(?i)\b(pin\s*code|pincode|postal\s*code|zip|aadhaar|aadhar|uid|pan|passport|employee\s*(id|code|no)|emp\s*id|roll\s*(no|number)|registration|enrol(l)?ment|account\s*(no|number)|ifsc|gst(in)?|cgpa|gpa|percentage|marks|salary|ctc|lpa|package|invoice|order\s*no|pf\s*(no|number)|esic|uan)\b"
DATE_LIKE = r"(?i)\b(19|20)\d{2}\s*[-–—to]+\s*((19|20)\d{2}|present|current|till\s*date)\b|\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b"
# points are hundredths
PHONE_POINTS = {
    "base": 35, "own_label": 40, "foreign_label": -30, "header": 25, "below_header": 10,
    "personal_details": 20, "references": -60, "third_party": -55, "employer": -25,
    "indian_mobile": 15, "landline": -5, "email_line": 12,
}
PHONE_FLOOR = 32
TOP_CONFIDENCE = 99

# ---------------------------------------------------------------- fixed values
# Names.
NAME_LABEL = r"(?i)^(candidate\s*name|full\s*name|name\s*of\s*(the\s*)?candidate|applicant\s*name|name)$"
NOT_A_NAME = r"(?i)\b(resume|curriculum\s*vitae|\bcv\b|bio\s*-?\s*data|biodata|profile|objective|summary|declaration|reference|experience|education|skills?|projects?|address|contact|email|mobile|phone|date\s*of\s*birth|dob|nationality|gender|marital|languages?|hobbies|interests|achievements|certification|university|college|institute|school|academy|ltd|limited|pvt|private|llp|inc|corporation|company|technologies|solutions|services|systems|consultancy|enterprises|industries|infotech|software|hospital|bank|obtain|seeking|challenging|position|opportunity|organisation|organization|responsible|hardworking|dedicated)\b"
NAME_HONORIFIC = r"(?i)^(mr|mrs|ms|miss|dr|er|prof|shri|smt|sri|md|col|capt)\.?\s+"
NAME_SUFFIX = r"(?i)\s+(jr|sr|ii|iii)\.?$"
NAME_TOKEN = r"^[\p{Lu}][\p{L}'’-]*\.?$|^[\p{Lu}]\.$"
NAME_JOINERS = r"[,|•·–—]+"
CONTACT_DIGITS = r"(?:\+?\d[\d\s().-]{7,})"
CONTACT_URL = r"(?i)\b(https?://|www\.)\S+"
FILE_TOKEN_SPLIT = r"[\s._\-()\[\]0-9]+"
EMAIL_TOKEN_SPLIT = r"[._\-+0-9]+"
FILE_TOKEN_STOP = ["resume", "cv", "curriculum", "vitae", "biodata", "bio", "data", "final", "updated", "new", "copy", "doc", "pdf", "docx"]
NAME_POINTS = {"label": 62, "header_top": 42, "header_step": 5, "header_min": 12, "details": 30, "adjacent": 22, "fallback": 20}

# ---------------------------------------------------------------- fixed values
# Roles.
ROLE_STOP_TOKENS = ["a", "an", "the", "of", "for", "in", "and", "to", "as", "with", "position", "role", "job", "post", "profile", "opening", "vacancy"]
SENIORITY_PREFIXES = ["Senior", "Sr", "Sr.", "Junior", "Jr", "Jr.", "Lead", "Principal", "Chief", "Head", "Assistant", "Associate", "Trainee", "Intern", "Graduate", "Entry Level", "Fresher", "Executive", "Deputy", "Vice"]
GENERIC_TITLES = ["Job Seeker", "Candidate", "Professional", "Employee", "Worker", "Fresher", "Student", "Graduate", "Any", "Any Role", "Any Position", "Suitable Position", "Challenging Position", "Looking For A Job", "Seeking Employment", "Opportunity", "Career", "Position", "Role", "Job", "Work", "Employment", "Resume", "CV", "Curriculum Vitae", "Bio Data", "Biodata", "Not Found", "N/A", "NA", "None"]
APPLIED_LABEL = r"(?i)^(position\s*applied(\s*for)?|applied\s*for|applying\s*for|post\s*applied(\s*for)?|job\s*(role|profile|title|position)|role\s*applied(\s*for)?|desired\s*(position|role|job)|position\s*sought|preferred\s*(role|position)|apply\s*for|position|role|post|designation\s*applied)$"
CURRENT_LABEL = r"(?i)^(current\s*(designation|position|role|job\s*title)|designation|present\s*(position|role)|job\s*title|title)$"
INTENT_PATTERNS = [
    r"(?i)\b(?:seeking|searching|looking)\s+(?:for\s+)?(?:a\s+|an\s+|the\s+)?(?:challenging\s+|suitable\s+|rewarding\s+)?(?:opportunit(?:y|ies)\s+as\s+|role\s+as\s+|position\s+as\s+|job\s+as\s+|career\s+as\s+|opportunit(?:y|ies)\s+in\s+|position\s+of\s+|role\s+of\s+)(?:a\s+|an\s+)?([^.,;:\n()]{3,60})",
    r"(?i)\b(?:to\s+work|want\s+to\s+work|wish\s+to\s+work|aspire\s+to\s+work)\s+as\s+(?:a\s+|an\s+)?([^.,;:\n()]{3,60})",
    r"(?i)\b(?:apply(?:ing)?\s+for)\s+(?:the\s+)?(?:post\s+of\s+|position\s+of\s+|role\s+of\s+)?(?:a\s+|an\s+)?([^.,;:\n()]{3,60})",
    r"(?i)\b(?:position|role|post)\s+of\s+(?:a\s+|an\s+)?([^.,;:\n()]{3,60})",
    r"(?i)\b(?:as\s+an?\s+)([^.,;:\n()]{3,50})\s+(?:in\s+a\s+(?:reputed|reputable|growing|leading)|with\s+a\s+(?:reputed|reputable|growing|leading))",
]
TITLE_QUALIFIER = r"(?i)\s+(?:in|at|with|for)\s+(?:a|an|the)?\s*(?:reputed|reputable|growing|leading|good|well[\s-]known|dynamic|progressive|esteemed)\b.*$"
TITLE_RELATIVE = r"(?i)\s+(?:where|which|that|who)\b.*$"
TITLE_HEAD_NOUN = r"(?i)\s+(?:position|role|post|profile|job|vacancy|opening)$"
TITLE_ARTICLE = r"(?i)^(?:the|a|an)\s+"
TITLE_NOUN = r"(?i)\b(engineer|developer|analyst|manager|executive|specialist|consultant|designer|administrator|architect|scientist|officer|associate|assistant|coordinator|lead|head|director|intern|trainee|technician|operator|supervisor|accountant|auditor|recruiter|writer|editor|marketer|representative|advisor|strategist|planner|programmer|tester|nurse|teacher|professor|lecturer|clerk|agent|counsellor|counselor)\b"
ROLE_POINTS = {"tier1": 72, "tier2": 58, "intent_boost": 8, "joined": -2, "tier3": 50, "tier4": 46, "tier5_label": 30, "tier5_first": 26, "match": 12}
TIER_CEILING = {1: 97, 2: 90, 3: 82, 4: 78, 5: 55}
# A custom taxonomy must stay inside these limits: (min, max) lengths and counts.
TAXONOMY_LIMITS = {
    "version": (1, 20), "families": (1, 100), "family": (2, 60), "roles": (1, 500),
    "canonical": (2, 80), "aliases": (0, 40), "alias": (1, 80),
    "seniorityPrefixes": (0, 100), "prefix": (1, 30), "genericRejects": (0, 300), "reject": (1, 60),
}

# ---------------------------------------------------------------- fixed values
# Validation and review.
NAME_REJECTS = [
    r"(?i)^(resume|cv|curriculum\s*vitae|bio[\s-]*data|biodata|profile|candidate|applicant|name)$",
    r"(?i)\b(pvt|private|ltd|limited|llp|inc|corp|corporation|company|co\.|technologies|technology|solutions|systems|services|consulting|consultancy|group|enterprises|industries|infotech|software|labs|bank|university|college|institute|school|academy|hospital|foundation|trust|association)\b",
    r"(?i)\b(hr|human resources|recruiter|hiring manager|talent acquisition|reference|referee)\b",
    r"[@#$%^&*_=+<>{}\[\]\\|/]",
    r"\d{3,}",
    r"(?i)\bhttps?:|www\.",
]
VALID_NAME = r"^[\p{L}][\p{L}'.\- ]*$"
VALID_HONORIFIC = r"(?i)^(mr|mrs|ms|miss|dr|er|prof|shri|smt|sri)\.?\s+"
ROLE_REJECTS = [
    r"(?i)^(job\s*seeker|candidate|professional|employee|worker|fresher|student|graduate|intern(ship)?|any|any\s*(suitable\s*)?(role|position|job)|open\s*to\s*(any|all)|looking\s*for\s*(a\s*)?job|seeking\s*(a\s*)?(job|employment|opportunity)|n/?a|none|unknown|not\s*(specified|mentioned|found))$",
    r"(?i)^(a\s+)?(suitable|challenging|good|rewarding|growth[- ]oriented)\s+(position|role|job|career|opportunity)",
    r"(?i)^(position|role|job|career|opportunity|employment)$",
]
ROLE_BAD_CHARS = r"[@#$%^&*_=+<>{}\[\]\\|]"
MISSING_VALUE = r"(?i)^not\s*found$|^(n/?a|null|undefined|none|-)$"
THRESHOLD = 750  # thousandths
FIELD_WEIGHTS = {"name": 40, "phone": 35, "role": 25}  # per cent
OCR_BANDS = [(0.9, 100), (0.75, 94), (0.6, 85)]
OCR_WORST = 70

# ---------------------------------------------------------------- fixed values
# Text preparation.
OCR_MIN_CHARS = 150
TRUNCATION_MARK = "\n\n[... truncated ...]\n\n"
REPEAT_LINE_CHARS = 25
MIN_TEXT_CHARS = 20
CONTROL_CHARS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}
QUOTES_FROM, QUOTES_TO = "‘’‚“”„–—− ", "'''\"\"\"--- "

# ---------------------------------------------------------------- fixed values
# Export, errors, time limits.
EXPORT_HEADERS = ["Candidate Name", "Phone Number", "Job Role Applied For", "CV File Name", "CV Link", "Source", "Status", "Confidence", "Processed At"]
EXPORT_CHUNK = 2000
FORMULA_START = r"^[=+\-@\t\r]"
SAFE_NUMERIC = r"^[+-][\d\s().-]+$"
QUOTA_WORDS = r"(?i)insufficient_quota|credit_balance_exhausted|billing_hard_limit_reached|quota|no credits remaining|credit balance is too low|exceeded your current quota"
TRANSIENT_CODES = ["ECONNRESET", "ETIMEDOUT", "ECONNREFUSED", "EAI_AGAIN", "EPIPE", "UND_ERR_SOCKET", "UND_ERR_CONNECT_TIMEOUT"]
TRANSIENT_WORDS = r"rate limit|timeout|timed out|overloaded|fetch failed"
HEARTBEAT_TTL_SECONDS = 20
STALE_CLAIM_SECONDS = 180
ACTIVE_STATUSES = ["PENDING", "PROCESSING"]
PARSED_STATUSES = ["PROCESSED", "NEEDS_REVIEW"]
STATUSES = ["PENDING", "PROCESSING", "PROCESSED", "NEEDS_REVIEW", "FAILED", "SKIPPED"]
USER_ROLES = ["OWNER", "ADMIN", "RECRUITER"]
PROMPT_CHARS, REPLY_TOKENS, CHARS_PER_TOKEN = 2158, 80, 4
MODEL_PRICES = [("gpt-4o-mini", 0.15, 0.60), ("llama-3.3-70b", 0.12, 0.30), ("claude-haiku-3.5", 0.80, 4.00), ("gpt-4o", 2.50, 10.00)]
# Settings: (key, type, min, max, default); str bounds are lengths.
SETTINGS = [
    ("confidenceThreshold", "double", 0, 1, 0.75),
    ("highConfidenceThreshold", "double", 0, 1, 0.9),
    ("reviewThreshold", "double", 0, 1, 0.75),
    ("extractionEngine", "enum", None, None, "local"),
    ("maxFileSizeMb", "int", 1, 200, 15),
    ("maxFilesPerRequest", "int", 1, 200, 25),
    ("maxRetries", "int", 0, 10, 3),
    ("retryBackoffMs", "int", 500, 600000, 5000),
    ("workerConcurrency", "int", 1, 50, 3),
    ("llmRateLimitPerMinute", "int", 1, 10000, 60),
    ("llmModel", "string", 1, 200, "gpt-4o-mini"),
    ("llmTemperature", "double", 0, 2, 0.0),
    ("llmTimeoutMs", "int", 1000, 600000, 60000),
    ("llmPromptVersion", "string", 1, 20, "v1"),
    ("maxCvTextChars", "int", 1000, 200000, 20000),
    ("ocrMinTextChars", "int", 0, 100000, 150),
    ("ocrMaxPages", "int", 1, 50, 5),
    ("ocrLanguages", "string", 2, 50, "eng"),
    ("driveSyncIntervalMinutes", "int", 1, 1440, 5),
    ("driveFolderId", "nullable", 0, 200, None),
    ("sheetsSpreadsheetId", "nullable", 0, 200, None),
]
ENGINES = ["local", "shadow", "legacy"]
