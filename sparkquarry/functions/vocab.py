"""Word lists, patterns and lookup tables as data; operators turn them into expressions."""

from __future__ import annotations

# Compatibility needs exactly these entries in exactly this order.

#: Heading pattern -> section type, first match wins.
SECTIONS = {
    r"chief\s+complaint|cc": "chief_complaint",
    r"history\s+of\s+present\s+illness|hpi": "hpi",
    r"past\s+medical\s+history|pmh": "pmh",
    r"medications?|meds?": "medications",
    r"allergies?": "allergies",
    r"review\s+of\s+systems|ros": "ros",
    r"physical\s+exam(?:ination)?|pe": "physical_exam",
    r"vital\s+signs?|vitals?": "vital_signs",
    r"lab(?:oratory)?\s+(?:results?|findings?|data)": "lab_results",
    r"imaging|radiology|x-?ray|ct|mri": "imaging",
    r"assessment\s+(?:and|&)?\s+plan|a&p|a/p": "assessment_plan",
    r"diagnosis|diagnoses|dx": "diagnosis",
    r"impression": "impression",
    r"plan|treatment\s+plan": "treatment_plan",
    r"discharge\s+(?:summary|instructions?)": "discharge",
    r"follow[\s-]?up": "followup",
    r"indication": "indication",
    r"dosage?\s+(?:and\s+)?administration": "dosage",
    r"contraindications?": "contraindications",
    r"warnings?\s+(?:and\s+)?precautions?": "warnings",
    r"adverse\s+reactions?|side\s+effects?": "adverse_reactions",
    r"drug\s+interactions?": "drug_interactions",
    r"guidelines?": "guideline",
    r"protocols?": "protocol",
    r"recommendations?": "recommendations",
    r"inclusion\s+criteria": "inclusion_criteria",
    r"exclusion\s+criteria": "exclusion_criteria",
}

#: The shorter table of the entity-model chunker.
NER_SECTIONS = {
    r"chief\s+complaint|cc": "chief_complaint",
    r"medications?|meds?": "medications",
    r"allergies?": "allergies",
    r"physical\s+exam(?:ination)?|pe": "physical_exam",
    r"assessment\s+(?:and|&)?\s+plan|a&p": "assessment_plan",
    r"dosage?\s+(?:and\s+)?administration": "dosage",
    r"contraindications?": "contraindications",
    r"adverse\s+reactions?|side\s+effects?": "adverse_reactions",
}

#: Section type -> category that search boosts.
BOOST_SECTIONS = {
    "medications": "dosage",
    "dosage": "dosage",
    "administration": "dosage",
    "contraindications": "contraindications",
    "drug_interactions": "contraindications",
    "warnings": "contraindications",
    "adverse_reactions": "side_effects",
    "side_effects": "side_effects",
    "diagnosis": "diagnosis",
    "clinical_features": "diagnosis",
    "symptoms": "diagnosis",
    "signs": "diagnosis",
    "treatment": "treatment",
    "management": "treatment",
    "therapy": "treatment",
    "guidelines": "treatment",
    "procedure": "procedure",
    "protocol": "procedure",
    "technique": "procedure",
    "prevention": "prevention",
    "prophylaxis": "prevention",
}

BACKFILL_BOOST_SECTIONS = {
    "medications": "dosage",
    "dosage": "dosage",
    "contraindications": "contraindications",
    "adverse_reactions": "side_effects",
    "treatment": "treatment",
    "diagnosis": "diagnosis",
}

#: Section type -> answer type, for chunks with model entities.
SECTION_ANSWERS = {
    "contraindications": "contraindications",
    "adverse_reactions": "side_effects",
    "dosage": "dosage",
    "diagnosis": "diagnosis",
    "treatment": "treatment",
    "prevention": "prevention",
}

#: Words in a table's header row -> table type, first match wins.
TABLE_TYPES = {
    "lab_results": ["test", "result", "value", "range", "unit"],
    "medications": ["medication", "drug", "dose", "frequency", "route"],
    "vital_signs": ["vital", "bp", "hr", "temp", "spo2"],
}

#: Answer type -> phrases, any of which in the lower-cased text gives the label.
ANSWER_TYPES = {
    "definition": ["is a", "refers to", "defined as", "means", "definition", "also known as", "abbreviated as"],
    "dosage": ["dose", "dosage", "dosing", "mg", "mcg", "ml", "units", "administration", "frequency", "daily", "twice", "three times", "every", "hours", "bid", "tid", "qid", "prn"],
    "side_effects": ["side effect", "adverse", "reaction", "complication", "toxicity", "warning", "caution", "risk"],
    "contraindications": ["contraindication", "do not use", "avoid", "interaction", "should not", "must not", "incompatible", "allergy", "hypersensitivity", "precaution"],
    "treatment": ["treatment", "therapy", "management", "protocol", "guideline", "recommendation", "approach", "intervention"],
    "diagnosis": ["diagnosis", "diagnostic", "symptom", "sign", "test", "screening", "examination", "finding", "presentation", "criteria", "evaluation"],
    "procedure": ["procedure", "technique", "method", "step", "perform", "operation", "surgical", "protocol for"],
    "prevention": ["prevent", "prevention", "prophylaxis", "reduce risk", "avoid", "protective", "screening for prevention"],
    "comparison": ["versus", "vs", "compared to", "difference between", "better than", "worse than", "alternative"],
}

BACKFILL_ANSWER_TYPES = {
    "definition": ["is a", "refers to", "defined as", "means"],
    "dosage": ["mg", "ml", "dose", "dosage", "administration"],
    "side_effects": ["side effect", "adverse", "reaction", "complication"],
    "contraindications": ["contraindication", "do not use", "avoid", "interaction"],
    "treatment": ["treatment", "therapy", "management", "protocol"],
    "diagnosis": ["diagnosis", "diagnostic", "symptom", "sign", "test"],
}

#: Entity type -> patterns, for chunks.
CHUNK_ENTITIES = {
    "drug": [r"\b(\w+)(cillin|cycline|mycin|statin|pril|sartan|olol|azole|prazole|pine|done|pam|zepam)\b", r"\b(aspirin|insulin|metformin|lisinopril|atorvastatin|levothyroxine|amlodipine|ibuprofen)\b"],
    "disease": [r"\b(\w+)(itis|osis|emia|oma|pathy|syndrome|disease|disorder)\b", r"\b(diabetes|hypertension|cancer|asthma|arthritis|pneumonia|covid|influenza)\b"],
    "procedure": [r"\b(\w+)(scopy|ectomy|otomy|plasty|graphy|gram)\b", r"\b(surgery|biopsy|examination|screening|test|scan)\b"],
}

#: Entity type -> patterns, for queries.
QUERY_ENTITIES = {
    "drug": [r"\b(\w+)(cillin|cycline|mycin|statin|pril|sartan|olol|azole|prazole|pine|done|pam|zepam)\b", r"\b(aspirin|insulin|metformin|lisinopril|atorvastatin|levothyroxine|amlodipine)\b"],
    "disease": [r"\b(\w+)(itis|osis|emia|oma|pathy|syndrome|disease|disorder)\b", r"\b(diabetes|hypertension|cancer|asthma|arthritis|pneumonia)\b"],
    "symptom": [r"\b(pain|ache|fever|cough|nausea|vomiting|diarrhea|fatigue|weakness)\b", r"\b(\w+)(algia|dynia)\b"],
    "procedure": [r"\b(\w+)(scopy|ectomy|otomy|plasty|graphy|gram)\b", r"\b(surgery|biopsy|examination|screening|test)\b"],
    "lab_test": [r"\b(blood|urine|lab|test)\s+\w+", r"\b(\w+)\s+(level|count|test|panel)\b"],
}

ABBREVIATIONS = {
    "dm": "diabetes mellitus",
    "dm1": "diabetes mellitus type 1",
    "dm2": "diabetes mellitus type 2",
    "t1dm": "type 1 diabetes mellitus",
    "t2dm": "type 2 diabetes mellitus",
    "htn": "hypertension",
    "mi": "myocardial infarction",
    "chf": "congestive heart failure",
    "copd": "chronic obstructive pulmonary disease",
    "cad": "coronary artery disease",
    "cvd": "cardiovascular disease",
    "ckd": "chronic kidney disease",
    "esrd": "end stage renal disease",
    "gerd": "gastroesophageal reflux disease",
    "ibs": "irritable bowel syndrome",
    "uti": "urinary tract infection",
    "uri": "upper respiratory infection",
    "dvt": "deep vein thrombosis",
    "pe": "pulmonary embolism",
    "tia": "transient ischemic attack",
    "cva": "cerebrovascular accident",
    "ms": "multiple sclerosis",
    "ra": "rheumatoid arthritis",
    "oa": "osteoarthritis",
    "tb": "tuberculosis",
    "hiv": "human immunodeficiency virus",
    "aids": "acquired immunodeficiency syndrome",
    "sob": "shortness of breath",
    "cp": "chest pain",
    "ha": "headache",
    "n/v": "nausea and vomiting",
    "abd": "abdominal",
    "gi": "gastrointestinal",
    "abx": "antibiotics",
    "tx": "treatment",
    "rx": "prescription",
    "dx": "diagnosis",
    "sx": "symptoms",
    "hx": "history",
    "pmh": "past medical history",
    "prn": "as needed",
    "po": "by mouth",
    "iv": "intravenous",
    "im": "intramuscular",
    "sq": "subcutaneous",
    "subq": "subcutaneous",
    "bid": "twice daily",
    "tid": "three times daily",
    "qid": "four times daily",
    "qd": "once daily",
    "qod": "every other day",
    "qhs": "at bedtime",
    "ac": "before meals",
    "pc": "after meals",
    "cbc": "complete blood count",
    "bmp": "basic metabolic panel",
    "cmp": "comprehensive metabolic panel",
    "lfts": "liver function tests",
    "tsh": "thyroid stimulating hormone",
    "hba1c": "hemoglobin a1c",
    "ekz": "electrocardiogram",
    "ecg": "electrocardiogram",
    "echo": "echocardiogram",
    "cxr": "chest x-ray",
    "ct": "computed tomography",
    "mri": "magnetic resonance imaging",
    "us": "ultrasound",
    "cv": "cardiovascular",
    "gu": "genitourinary",
    "cns": "central nervous system",
    "mg": "milligrams",
    "mcg": "micrograms",
    "ml": "milliliters",
    "l": "liters",
}

MISSPELLINGS = {
    "diabetis": "diabetes",
    "diabets": "diabetes",
    "hypertenion": "hypertension",
    "hypertention": "hypertension",
    "astma": "asthma",
    "athsma": "asthma",
    "neumonia": "pneumonia",
    "pneumoia": "pneumonia",
    "diarhea": "diarrhea",
    "diarrea": "diarrhea",
    "metropolol": "metoprolol",
    "metroprolol": "metoprolol",
    "metaformin": "metformin",
    "metformine": "metformin",
    "lisinipril": "lisinopril",
    "lisinapril": "lisinopril",
    "amoxicilin": "amoxicillin",
    "amoxacillin": "amoxicillin",
    "ibuprophen": "ibuprofen",
    "ibuprofin": "ibuprofen",
    "acetominophen": "acetaminophen",
    "acetaminophin": "acetaminophen",
    "omeprezole": "omeprazole",
    "omeprazol": "omeprazole",
    "colonoscapy": "colonoscopy",
    "endoscapy": "endoscopy",
    "mamogram": "mammogram",
    "mamography": "mammography",
}

SYNONYMS = {
    "diabetes": ["diabetes mellitus", "dm"],
    "hypertension": ["high blood pressure", "htn", "elevated blood pressure"],
    "myocardial infarction": ["heart attack", "mi", "acute mi"],
    "metformin": ["glucophage", "fortamet", "glumetza"],
    "acetaminophen": ["tylenol", "paracetamol", "apap"],
}

TERM_SUFFIXES = ["itis", "osis", "emia", "oma", "pathy", "algia", "dynia", "scopy", "ectomy", "otomy", "plasty", "graphy", "gram"]

#: Intent -> patterns (1 point each); the order breaks ties.
INTENT_PATTERNS = {
    "definition": [r"\b(what|define|definition|meaning)\s+(is|are|of)\b", r"\b(what\s+is|what\s+are)\s+\w+", r"\b(explain|describe)\s+\w+", r"^\w+\?$", r"\b(tell\s+me\s+about)\b"],
    "diagnosis": [r"\b(diagnos[ei]|diagnostic|detect|identify|test)\b", r"\b(symptoms?|signs?|manifestations?|presentations?)\s+(of|for)\b", r"\b(how\s+to\s+diagnose|diagnosis\s+of)\b", r"\b(screening|evaluation)\s+(for|of)\b", r"\b(clinical\s+features?|diagnostic\s+criteria)\b"],
    "treatment": [r"\b(treat|treatment|therapy|management|cure)\b", r"\b(how\s+to\s+treat|treatment\s+for|manage)\b", r"\b(therapeutic|intervention|protocol)\b", r"\b(first[\s-]line|second[\s-]line|treatment\s+options?)\b", r"\b(guidelines?\s+for\s+treating)\b"],
    "dosage": [r"\b(dosage?|dose|dosing|amount|quantity)\b", r"\b(how\s+much|mg|mcg|ml|unit[s]?)\b", r"\b(daily\s+dose|maximum\s+dose|recommended\s+dose)\b", r"\b(administration|frequency|schedule)\b", r"\b(pediatric\s+dose|adult\s+dose|geriatric\s+dose)\b"],
    "side_effects": [r"\b(side[\s-]?effects?|adverse[\s-]?reactions?|complications?)\b", r"\b(toxicity|safety|risks?|warnings?)\b", r"\b(adverse\s+events?|untoward\s+effects?)\b", r"\b(harmful\s+effects?|negative\s+effects?)\b"],
    "contraindications": [r"\b(contraindications?|when\s+not\s+to)\b", r"\b(interactions?|drug[\s-]?interactions?)\b", r"\b(avoid|should\s+not|must\s+not)\b", r"\b(incompatible|conflicts?\s+with)\b", r"\b(precautions?|warnings?)\s+for\b"],
    "comparison": [r"\b(\w+)\s+vs\.?\s+(\w+)\b", r"\b(difference|comparison|compare)\s+between\b", r"\b(better|worse|versus|compared\s+to)\b", r"\b(advantages?\s+of|disadvantages?\s+of)\b", r"\b(which\s+is\s+better)\b"],
    "procedure": [r"\b(procedure|protocol|technique|method)\b", r"\b(how\s+to\s+perform|steps?\s+for|process\s+of)\b", r"\b(surgical|operative|intervention)\s+technique\b", r"\b(guidelines?\s+for\s+performing)\b"],
    "prevention": [r"\b(prevent|prevention|prophylaxis|avoid)\b", r"\b(how\s+to\s+prevent|prevention\s+of)\b", r"\b(risk\s+factors?|reduce\s+risk)\b", r"\b(preventive\s+measures?|precautions?)\b"],
}

#: Intent -> substrings (half a point each).
INTENT_KEYWORDS = {
    "definition": ["what", "is", "are", "define", "definition", "meaning"],
    "diagnosis": ["diagnose", "diagnosis", "symptoms", "signs", "test", "screening"],
    "treatment": ["treat", "treatment", "therapy", "management", "cure", "protocol"],
    "dosage": ["dose", "dosage", "mg", "ml", "mcg", "units", "daily", "frequency"],
    "side_effects": ["side effects", "adverse", "reactions", "complications", "toxicity"],
    "contraindications": ["contraindications", "interactions", "avoid", "not use"],
    "comparison": ["vs", "versus", "compare", "difference", "better", "between"],
    "procedure": ["procedure", "how to perform", "technique", "steps", "protocol"],
    "prevention": ["prevent", "prevention", "avoid", "prophylaxis", "reduce risk"],
}

SPECIFIC_SOURCE_INTENTS = ["dosage", "contraindications", "procedure"]

#: Intent -> (answer types, boosted sections, entity types) that search uses; others as "general".
INTENT_CONFIG = {
    "dosage": (["dosage", "definition"], ["dosage", "dosage_administration", "administration"], ["drug"]),
    "side_effects": (["side_effects"], ["adverse_reactions", "side_effects", "warnings"], ["drug"]),
    "contraindications": (["contraindications"], ["contraindications", "warnings", "precautions"], ["drug", "disease"]),
    "diagnosis": (["diagnosis", "definition"], ["diagnosis", "clinical_features", "symptoms"], ["disease"]),
    "treatment": (["treatment"], ["treatment", "management", "therapy", "guidelines"], ["disease", "drug", "procedure"]),
    "comparison": (["comparison"], ["comparison", "differences"], ["drug", "disease"]),
    "procedure": (["procedure"], ["procedure", "technique", "method"], ["procedure"]),
    "general": (["general"], [], []),
}

#: Intent -> boost weight; others as "general".
BOOST_WEIGHTS = {"dosage": 1.3, "side_effects": 1.3, "contraindications": 1.3, "diagnosis": 1.2, "treatment": 1.2, "comparison": 1.2, "procedure": 1.2, "general": 1.0}

#: Intent -> (chunk types, precision required, least confidence) of the retrieval strategy.
STRATEGIES = {
    "definition": (["heading", "text"], False, 0.60),
    "diagnosis": (["text", "list", "table"], True, 0.70),
    "treatment": (["text", "list", "medication"], True, 0.75),
    "dosage": (["medication", "table", "text"], True, 0.80),
    "side_effects": (["text", "list", "table"], True, 0.75),
    "contraindications": (["text", "list", "warning"], True, 0.80),
    "comparison": (["text", "table", "list"], False, 0.65),
    "procedure": (["text", "list", "table"], True, 0.75),
    "prevention": (["text", "list"], False, 0.65),
    "general": (["text", "heading", "table", "list"], False, 0.50),
}

#: Intent -> templates for each drug, in search variants.
DRUG_VARIANTS = {
    "dosage": ["{} dosage", "{} dose", "how much {}"],
    "side_effects": ["{} side effects", "{} adverse reactions", "{} adverse effects"],
    "contraindications": ["{} contraindications", "when not to use {}", "{} warnings"],
}

#: Intent -> templates for the cleaned query; those of dosage are for each drug.
INTENT_TEMPLATES = {
    "definition": ["what is {}", "{} definition medical", "{} overview", "{} explanation"],
    "diagnosis": ["{} diagnostic criteria", "{} signs symptoms", "how to diagnose {}", "{} clinical features"],
    "treatment": ["{} treatment guidelines", "{} management protocol", "{} therapy options", "treating {}"],
    "dosage": ["{} dosage administration", "{} dose mg", "{} dosing schedule", "{} recommended dose"],
    "side_effects": ["{} adverse reactions", "{} side effects complications", "{} safety warnings", "{} toxicity"],
    "contraindications": ["{} contraindications warnings", "{} drug interactions", "{} when not to use", "{} precautions"],
    "procedure": ["{} procedure steps", "{} surgical technique", "how to perform {}", "{} protocol guidelines"],
}

#: Part of a model's tag -> entity type, first match wins, else "other".
TAG_TYPES = {
    "drug": "drug",
    "medication": "drug",
    "medicine": "drug",
    "disease": "disease",
    "disorder": "disease",
    "condition": "disease",
    "problem": "disease",
    "symptom": "symptom",
    "sign": "symptom",
    "procedure": "procedure",
    "treatment": "procedure",
    "test": "test",
    "lab": "test",
    "anatomy": "anatomy",
    "body_part": "anatomy",
    "organ": "anatomy",
    "dosage": "dosage",
    "dose": "dosage",
    "frequency": "frequency",
    "duration": "duration",
    "route": "route",
    "strength": "strength",
    "gene": "gene_protein",
    "protein": "gene_protein",
    "chemical": "chemical",
}

ENTITY_ABBREVIATIONS = {
    "htn": "hypertension",
    "dm": "diabetes mellitus",
    "mi": "myocardial infarction",
    "chf": "congestive heart failure",
    "copd": "chronic obstructive pulmonary disease",
    "cad": "coronary artery disease",
    "ckd": "chronic kidney disease",
    "gerd": "gastroesophageal reflux disease",
    "bid": "twice daily",
    "tid": "three times daily",
    "qid": "four times daily",
    "prn": "as needed",
    "po": "by mouth",
    "iv": "intravenous",
}

#: Entity type -> (pattern, replacement) in order.
NORMALISATIONS = {
    "dosage": [(r"(\d+)\s*mg", "$1mg"), (r"(\d+)\s*ml", "$1ml"), (r"(\d+)\s*mcg", "$1mcg")],
    "frequency": [(r"twice\s+(?:a\s+)?day", "twice daily"), (r"three\s+times\s+(?:a\s+)?day", "three times daily"), (r"every\s+(\d+)\s+hours?", "q$1h")],
}

#: Words within 50 characters that raise an entity's confidence by a tenth.
CONTEXT_WORDS = {"drug": ["prescribed", "medication", "take", "dose"], "disease": ["diagnosed", "diagnosis", "history of"]}

#: Embedding type -> (dimensions, most tokens).
EMBEDDINGS = {
    "openai": (1536, 8191),
    "pubmedbert": (768, 512),
    "biobert": (768, 512),
    "scibert": (768, 512),
    "clinicalbert": (768, 512),
    "biolinkbert": (768, 512),
}
DOCUMENT_TYPES = ["GUIDELINE", "POLICY", "FAQ", "DOCUMENT"]
