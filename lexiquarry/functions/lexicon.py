"""Rule tables. The functions that use them take them as parameters, these are the defaults."""

from __future__ import annotations

# Patterns, codes, weights and thresholds that results depend on.

#: A topic is on a text where its pattern is found, in any case and across lines.
TOPICS = {
    "membership": r"\bmembership\b|admission of (?:a |the )?members?|who may become a member",
    "registration": r"\bregistration\b",
    "management": r"\bmanag(?:ement|ing|er)\b",
    "governance": r"\bgovernance\b|\bboard of directors\b",
    "elections": r"\belect(?:ion|ions|oral)\b",
    "meetings": r"\bmeetings?\b",
    "loans": r"\b(?:loans?|borrow(?:ing|er|ers)?)\b",
    "deposits": r"\bdeposits?\b",
    "financial_literacy": r"\bfinancial literacy\b",
    "pacs": r"\bPACS\b|primary agricultural credit societ",
    "pacs_services": r"\bPACS\b.{0,80}\bservices?\b|\bservices?\b.{0,80}\bPACS\b",
    "computerization": r"\bcomputeri[sz](?:ation|ed|ing)\b",
    "crop_insurance": r"\bcrop insurance\b",
    "pmfby": r"\bPMFBY\b|pradhan mantri fasal bima",
    "eligibility": r"\beligib(?:le|ility)\b",
    "premium": r"\bpremiums?\b",
    "crop_loss": r"\bcrop (?:loss|damage)|\bloss of crops?\b",
    "claim": r"\bclaim(?:s)?\s+(?:procedure|settlement|payment|processing|assessment|calculation|intimation)|\b(?:submit|file|settle|pay|process|assess)(?:ed|ing|ment)?\s+(?:the |a |insurance )?claims?\b",
    "reporting": r"\breport(?:ing|ed)\b|\bintimat(?:ion|e)\b",
    "documents": r"\bdocuments?\b|\bdocumentary\b",
    "timeline": r"\b(?:within \w+ days?|time[- ]limit|deadline|timeline|days from|hours of)\b",
    "grievance": r"\bgrievances?\b",
    "complaint": r"\bcomplain(?:t|ts|ant|ants)\b",
    "ombudsman": r"\bombudsman\b",
    "appeal": r"\bappeal(?:s|late)?\b",
    "form_vi": r"\bform\s*[-–]?\s*VI\b",
    "form_vii": r"\bform\s*[-–]?\s*VII\b",
    "registrar": r"\bregistrar\b",
    "multistate": r"\bmulti[- ]state\b",
    "state_law": r"\b(?:Karnataka|Maharashtra)\b.{0,100}\b(?:Act|Rules)\b",
    "byelaws": r"\bbye[- ]?laws?\b",
}

#: Lower-case strings of which each match of a topic's pattern holds one; texts without them need no pattern.
TOPIC_HINTS = {
    "membership": ["membership", "admission of", "who may become"], "registration": ["registration"], "management": ["manag"],
    "governance": ["governance", "board of directors"], "elections": ["elect"], "meetings": ["meeting"], "loans": ["loan", "borrow"],
    "deposits": ["deposit"], "financial_literacy": ["financial literacy"], "pacs": ["pacs", "primary agricultural"], "pacs_services": ["pacs"],
    "computerization": ["computeri"], "crop_insurance": ["crop insurance"], "pmfby": ["pmfby", "pradhan mantri"], "eligibility": ["eligib"],
    "premium": ["premium"], "crop_loss": ["crop"], "claim": ["claim"], "reporting": ["report", "intimat"], "documents": ["document"],
    "timeline": ["within", "time-limit", "time limit", "deadline", "timeline", "days from", "hours of"], "grievance": ["grievance"],
    "complaint": ["complain"], "ombudsman": ["ombudsman"], "appeal": ["appeal"], "form_vi": ["form"], "form_vii": ["form"],
    "registrar": ["registrar"], "multistate": ["multi"], "state_law": ["karnataka", "maharashtra"], "byelaws": ["bye"],
}

#: Topics that a source has by itself.
SOURCE_TOPICS = {
    "PMFBY_2023": ["crop_insurance", "pmfby"],
    "PACS_MODEL_BYLAWS": ["byelaws", "pacs"],
    "PACS_COMPUTERIZATION": ["computerization", "pacs"],
    "CRCS_OMBUDSMAN": ["grievance", "ombudsman"],
    "KA_ACT_1959": ["state_law"],
    "MH_ACT_1960": ["state_law"],
}
#: And by the start of its id.
PREFIX_TOPICS = {"MSCS_": ["multistate"]}

#: A source of which texts on who may take part are about eligibility too.
ELIGIBLE_SOURCE = "PMFBY_2023"
ELIGIBLE = r"(?:optional|compulsory|mandatory) for (?:all )?farmers|farmers (?:who|including)|eligible|eligibility"

#: A question is about a topic where one of its terms stands between other characters than a to z.
QUERY_TERMS = {
    "membership": ["member", "membership", "admission"],
    "registration": ["register", "registration"],
    "management": ["management", "governing body", "board"],
    "governance": ["governance"],
    "elections": ["election", "voting"],
    "meetings": ["meeting", "agenda"],
    "loans": ["loan", "borrowing", "credit"],
    "deposits": ["deposit"],
    "financial_literacy": ["financial literacy"],
    "pacs": ["pacs"],
    "pacs_services": ["pacs service"],
    "computerization": ["computeriz"],
    "crop_insurance": ["crop insurance"],
    "pmfby": ["pmfby", "pradhan mantri fasal"],
    "eligibility": ["eligible", "eligibility"],
    "premium": ["premium"],
    "crop_loss": ["crop loss", "crop damaged", "damage to crop"],
    "claim": ["claim"],
    "reporting": ["report", "reporting"],
    "documents": ["document"],
    "timeline": ["time limit", "timeline", "within one month", "within a period"],
    "grievance": ["grievance", "complain", "complaint", "dispute"],
    "complaint": ["complain", "complaint"],
    "ombudsman": ["ombudsman", "complain", "complaint"],
    "appeal": ["appeal"],
    "form_vi": ["form vi", "form 6"],
    "form_vii": ["form vii", "form 7"],
    "registrar": ["registrar"],
    "multistate": ["multi-state", "multistate", "more than one state"],
    "state_law": ["state law"],
    "byelaws": ["bye-law", "byelaw"],
}

PROCEDURAL_QUERY = r"\b(?:what should (?:i|we|a)\b|how (?:do|can|should)\b|next step\b|where (?:do|can|should)\b|what documents?\b|how to (?:report|claim|complain))"
PROCEDURAL_TOPICS = ["reporting", "claim", "documents", "timeline", "grievance", "complaint"]

#: Weights of a rerank score, in the order in which they are added.
SEMANTIC, TOPIC, HEADING, DIVERSITY, PROCEDURAL = 0.58, 0.22, 0.15, 0.05, 0.04
DENSE, TOP = 15, 5
LOW_SIMILARITY = 0.70

#: Warnings that keep a record from being served.
SEVERE = [
    "BILINGUAL_REVIEW",
    "EXTRACTION_QUALITY_REVIEW",
    "HEADER_DOMINATED",
    "HIERARCHY_REVIEW",
    "INCOMPLETE_PROVISION",
    "LEGACY_FONT_ENCODING_REVIEW",
    "MAJOR_DUPLICATE_TEXT",
    "MULTIPLE_AMENDMENT_ACTIONS",
    "ORPHAN_CHILD",
    "TABLE_CORRUPTION",
    "TOC_REVIEW",
]

ACTIONS = {
    "insertion": r"\binsert(?:ed|ion)\b",
    "substitution": r"\bsubstitut(?:ed|ion)\b",
    "omission": r"\bomitt?ed\b|\bomission\b",
    "renumbering": r"\brenumber(?:ed|ing)\b",
}
AFFECTED = r"\b(?:In|For|After|Before|of)\s+(?:the\s+)?(section|rule|sub-section|sub-rule)\s+(\d+[A-Z]?(?:\s*\([\da-z]+\))?)"
FORM = r"\bForm\s*[-–]?\s*(VII|VI|[IVXLCDM]+|[0-9]+|[A-Z](?:-[A-Z0-9]+)?)\b"
FORM_CONTEXT = r"fil(?:e|ing)|submit|complaint|appeal|application|prescribed form"

#: First match gives the reason for not answering.
PRECHECK = [
    ("SOCIETY_SPECIFIC_BYLAWS_NOT_IN_CORPUS", r"(?:my|our|the)\s+(?:society|cooperative).{0,80}(?:own|registered|society-specific).{0,40}bye[- ]?laws?"),
    ("CURRENT_SOCIETY_SPECIFIC_FACT_NOT_IN_CORPUS", r"(?:current|present)\s+(?:president|secretary|chairperson|officer)|who is the current"),
    ("CANNOT_GUARANTEE_OR_PREDICT_LEGAL_OUTCOME", r"\b(?:guarantee|predict|assure)\b|decided?\s+in\s+my\s+favo[u]?r"),
]
UNKNOWN_REASON = "UNKNOWN_JURISDICTION_FOR_STATE_DEPENDENT_LEGAL_QUESTION"
LEGAL_WORD = r"\b(?:law|act|rule|section|membership|registered|legal)\b"
NAMED_SCOPE = r"\b(?:karnataka|maharashtra|central|india|multi[- ]state)\b"

CENTRAL = ["Central", "India"]
CENTRAL_NAMES = ["central", "multi-state", "multistate", "multi state", "india", "pmfby", "central / multi-state", "india / pmfby"]
STATES = {
    "Karnataka": r"\bkarnataka\b|कर्नाटक|ಕರ್ನಾಟಕ",
    "Maharashtra": r"\bmaharashtra\b|महाराष्ट्र|ಮಹಾರಾಷ್ಟ್ರ",
}

#: A follow-up is a whole question of one of these forms.
INTENTS = {
    "documents": r"(?:what|which) documents? (?:do i need|are needed|required|should i (?:bring|submit|provide))\??",
    "timeline": r"(?:how long (?:will|does|would) it take|what is the (?:time|timeline)|when will it (?:finish|be done))\??",
    "destination": r"where (?:do|can|should) i (?:submit|report|file|complain|go)(?: (?:it|this))?\??",
    "next_step": r"(?:what (?:should i do )?next|what is the next step)\??",
    "appeal": r"(?:can i appeal|how (?:do|can|should) i appeal|what about (?:an )?appeal)\??",
    "eligibility": r"(?:am i eligible|who is eligible|what (?:are the )?eligibility requirements?|what could disqualify me|what (?:would|can) disqualify me)\??",
    "missed_deadline": r"what if i missed (?:the|that) deadline\??",
}
ANOTHER = r"what (?:about|if i have) another (?:problem|issue)\??"
DEPENDENT = r"\b(?:it|this|that|these|those|they|them|deadline|documents|appeal)\b"

#: Flags of a question from which its task follows.
FLAGS = {
    "crop": r"\b(?:crop|crop insurance|pmfby|insurance)\b",
    "crop_loss": r"\b(?:damage[ds]?|damaged|loss|lost|heavy rain|flood|hail|calamity|post[- ]harvest)\b",
    "complaint": r"\b(?:complain|complaint|grievance|ombudsman)\b",
    "membership": r"\b(?:become|join|membership|member|eligible|eligibility|disqualif(?:y|ied|ication))\b",
    "pacs": r"\bpacs\b",
    "multistate": r"\bmulti[- ]state\b",
    "deposit": r"\bdeposits?\b",
}
#: Subject and procedure of each task, as queries must have them (a complaint's subject follows from the question).
TASKS = {
    "crop_loss": (" after crop damage or loss", "crop-loss reporting, loss assessment, and insurance claim"),
    "complaint": ("", "complaint or Ombudsman filing for the "),
    "membership": ("cooperative society membership", "admission to cooperative society membership and disqualification from admission"),
    "pacs": ("PACS services", "the PACS service or request described by the user"),
    "multistate": ("multi-state cooperative issue", "the multi-state cooperative procedure described by the user"),
}
#: Focus of a follow-up; {} stands for the procedure.
FOCUS = {
    "documents": "required supporting documents for {}",
    "timeline": "timeline, processing time, and duration for {}",
    "destination": "authority, channel, or filing location for {}",
    "next_step": "next procedural step in {}",
    "appeal": "appeal relating to {}",
    "eligibility": "eligibility or disqualification relating to {}",
    "missed_deadline": "missed deadline in {}",
}
CROP_TIMELINE = "general procedure for settlement of crop-loss insurance claims; time frame for loss assessment and claims payment"

#: Reason of an abstention that asks for more.
CLARIFY = "NEEDS_CLARIFICATION"
#: Languages of requests.
LANGUAGES = ["en", "kn", "hi", "mr"]
#: Statuses of a responder after which it is asked again.
TRANSIENT = (429, 500, 502, 503, 504)
#: Limits of requests.
QUESTION_CHARS, CONTENT_CHARS, HISTORY, SPEECH_CHARS, AUDIO_BYTES, EVIDENCE_CHARS = 1500, 4000, 4, 4000, 5_000_000, 12_000

FURNITURE = r"gazette|government of|ministry of|department of|downloaded|www\.|https?://|operational guidelines|co-operative societies act|cooperative societies act|co-operative societies rules"
