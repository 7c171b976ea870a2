"""The code lists, value maps and word lists of the clinical study.

Everything here must equal the study's own constants for right results.
"""

ANTIBIOTICS = ["CEFAZOLIN", "CEFEPIME", "CEFPODOXIME", "CEFTAZIDIME", "CEFTRIAXONE", "CEFUROXIME"]

ORGANISMS = [
    80004,  # Klebsiella pneumoniae
    80026,  # Pseudomonas aeruginosa
    80005,  # Klebsiella oxytoca
    80017,  # Proteus mirabilis
    80040,  # Neisseria gonorrhoeae
    80008,  # Enterobacter cloacae
    80007,  # Enterobacter aerogenes
    80002,  # Escherichia coli
]
MRSA_POSITIVE = 80293
SCREEN_SPECIMEN = "MRSA SCREEN"

LAB_FLUIDS = ["blood", "urine"]
COMMON_LAB_COUNT = 100
EARLY_TEST_HOURS = 12

DRUG_STEMS = [
    "Amikacin", "Ampicillin", "Cefazolin", "Cefepime", "Cefpodoxime", "Ceftazidime", "Ceftriaxone", "Cefuroxime",
    "Chloramphenicol", "Ciprofloxacin", "Clindamycin", "Daptomycin", "Erythromycin", "Gentamicin", "Imipenem",
    "Levofloxacin", "Linezolid", "Meropenem", "Nitrofurantoin", "Oxacillin", "Penicillin", "Piperacillin",
    "Rifampin", "Tetracycline", "Tobramycin", "Trimethoprim", "Sulfonamide", "Vancomycin", "Tazobactam",
]

OPEN_WOUND_PREFIXES = ["870", "871", "872", "873", "874", "875", "876", "877", "878", "879"]
INTUBATION_CODES = ["31500", "32000", "32002"]

NOTE_KEYWORDS = [
    "antibiotic", "antibiotics", "amikacin", "ampicillin", "sulbactam", "cefazolin", "cefepime", "cefpodoxime",
    "ceftazidime", "ceftriaxone", "cefuroxime", "chloramphenicol", "ciprofloxacin", "clindamycin", "daptomycin",
    "erythromycin", "gentamicin", "imipenem", "levofloxacin", "linezolid", "meropenem", "nitrofurantoin",
    "oxacillin", "penicillin", "penicillin G", "piperacillin", "tazobactam", "rifampin", "tetracycline",
    "tobramycin", "trimethoprim", "vancomycin",
]

DROPPED_LABS = ["50827", "50856", "51100", "51482", "50981"]

# Side and characters of each strip, in order.
MEASUREMENT_STRIPS = [
    ("left", "LESS THAN "),
    ("left", "GREATER THAN "),
    ("left", ">GREATER THAN "),
    ("left", "<LESS THAN "),
    ("right", " NG/ML"),
    ("left", "<>"),
]
FAILURE_MESSAGES = [
    "UNABLE TO ANALYZE",
    "MOLYSIS FALSELY DECREASES THIS RESULT",
    "COMPUTER NETWORK FAILURE. TEST NOT RESULTED.",
    "UNABLE TO DETERMINE",
    ":UNABLE TO DETERMINE",
    "UNABLE TO QUANTITATE",
    "UNABLE TO REPORT",
]

# Codes without usable values: only "inf" and "nan", only "See comments", only "Random".
UNUSABLE_LOINC = ["26498-6", "33914-3", "13362-9"]

# Midpoints of counted ranges, shared by three urine counts.
RANGE_MIDPOINTS = {
    "0-2": "1.0", "3-5": "4.0", "11-20": "15.0", ">50": "80.0", "6-10": "8.0", "21-50": "35.0", "<1": "0.01",
    ">1000": "1100.0", "O-2": "1.0", " 3-5": "4.0", " ": None, "LOADED": None, " 0-2": "1.0", "NOTDONE": None,
    "0-20-2": None, "0-2+": None, "TNTC": None, "3/5": None, "21-200-2": None,
}

# (lab code, mode, map) in the order they are applied. "open": {target: sources},
# other values stay. "closed": {source: target}, other values become null.
LAB_RECODES = [
    ("51501", "open", {"0-2": ["<1", "1", "2"], "3-5": ["3", "4"]}),
    ("51506", "open", {"Clear": ["CLEAR"], "SlHazy": ["SLHAZY"], "Hazy": ["HAZY"], "SlCldy": ["SlCloudy"], "Cloudy": ["CLOUDY"]}),
    ("51463", "open", {"NEG": ["0"], "NONE": ["NOTDONE"], "MANY": ["LRG"]}),
    ("51508", "open", {
        "Yellow": ["YELLOW", "YEL"], "Straw": ["STRAW"], "Amber": ["AMBER", "AMB"], "Red": ["RED", "R"],
        "Orange": ["ORANGE", "O"], "DkAmb": ["DKAMB", "DKAMBER", "DKAMBE", "DRKAMBER"], None: [" "],
        "Other": ["GREEN", "Lt", "NONE", "DKBROWN", "Black", "HAZY", "LTBROWN", "BLUE"],
    }),
    ("51508", "closed", {"PINK": "Pink", "None": "NONE"}),
    ("51492", "open", {None: [" "]}),
    ("51514", "open", {"0.2": [".2"], ">8.0": [">8"], ">12.0": [">12"], None: ["NotDone", " "]}),
    ("51003", "open", {
        "0.001": ["<0.01", "LESS THAN 0.01", "<0.010", "LESS THAN 0.010", "<0.10", "<0.02", "LESS THAN 0.1"],
        "30.0": ["GREATER THAN 25.0", ">25.0", ">25", "GREATER THAN 25", ">25.00"],
    }),
    ("51519", "open", {"NONE": ["0", "N"], None: ["NOTDONE"]}),
    ("51266", "open", {"NOTDETECTED": ["UNABLE TO ESTIMATE DUE TO PLATELET CLUMPS"]}),
    ("51478", "closed", {"Neg": "NEG", "N": "NEG"}),
    ("51484", "closed", {"T": "TR", "Tr": "TR", "Neg": "NEG", ">80": "150.0"}),
    ("51492", "closed", {"Neg": "NEG", ">600": "600.0", ">300": "500.0"}),
    ("51463", "closed", {" ": "NONE", "F": "FEW", "MOD-": "MOD", "1.0": "RARE", "7I": "NONE", "2.0": "FEW"}),
    ("51003", "open", {
        None: ["NotDone", "NOT DONE", "ERROR", "NOT DONE , TOTAL CK LESS THAN 100"],
        "600.0": [">500", "GREATER THAN 500"], "0.0": ["<1"],
    }),
    ("50922", "open", {"-1.0": ["NEG", "NEGATIVE", "ERROR"]}),
    ("51493", "closed", RANGE_MIDPOINTS),
    ("51516", "closed", RANGE_MIDPOINTS),
    ("51476", "closed", {**RANGE_MIDPOINTS, "0-2,TRANS": "1.0", "<1 /HPF": "0.5", "11-20-": "15.0", "0.-2": "1.0"}),
    ("50911", "closed", {
        "NotDone": None, ">500": "600.0", "GREATER THAN 500": "550.0", "NOT DONE": None, "<1": "0.0", "ERROR": None,
        "NOT DONE , TOTAL CK LESS THAN 100": None,
    }),
    ("50924", "closed", {
        "GREATER THAN 2000": "5900.0", "GREATER THAN 1000": "1500.0", ">2000": "5900.0", "GREATER THEN 2000": "5900.0",
        "> 2000": "5900.0",
    }),
]

# The research variant, by LOINC code.
LOINC_RECODES = [
    ("30089-7", "open", {"0-2": ["<1", "1", "2"], "3-5": ["3", "4"]}),
    ("5767-9", "open", {"Clear": ["CLEAR"], "SlHazy": ["SLHAZY"], "Hazy": ["HAZY"], "SlCldy": ["SlCloudy"], "Cloudy": ["CLOUDY"]}),
    ("5769-5", "open", {"NEG": ["0"], "NONE": ["NOTDONE"], "MANY": ["LRG"]}),
    ("5778-6", "open", {
        "Yellow": ["YELLOW", "YEL"], "Straw": ["STRAW"], "Amber": ["AMBER", "AMB"], "Red": ["RED"],
        "Orange": ["ORANGE"], "DkAmb": ["DKAMB", "DKAMBER"], None: [" "],
    }),
    ("5797-6", "open", {"80": [">80"]}),
    ("5804-0", "open", {"300": [">300"], None: [" "]}),
    ("5818-0", "open", {"0.2": [".2"], "8": [">8", ">8.0"], "12": [">12"], None: ["NotDone"]}),
    ("5822-2", "open", {"NONE": ["0", "N"], None: ["NOTDONE"]}),
    ("778-1", "open", {"NOTDETECTED": ["UNABLE TO ESTIMATE DUE TO PLATELET CLUMPS"]}),
]

STATIC_CATEGORIES = [
    "admission_type", "admission_location", "insurance", "language", "religion", "marital_status", "ethnicity", "gender",
]
ADMISSION_LOCATIONS = {
    "EMERGENCY ROOM ADMIT": ["** INFO NOT AVAILABLE **"],
    "TRANSFER FROM MED FACILITY": ["TRANSFER FROM SKILLED NUR", "TRANSFER FROM OTHER HEALT", "TRANSFER FROM HOSP/EXTRAM"],
}
LANGUAGES = ["ENGL", "SPAN"]
RELIGIONS = ["CATHOLIC", "NOT SPECIFIED", "UNOBTAINABLE", "PROTESTANT QUAKER", "JEWISH"]
RELIGION_GROUPS = {"NOT SPECIFIED": ["UNOBTAINABLE"]}
ETHNICITIES = {
    "ASIAN": ["ASIAN - CHINESE", "ASIAN - ASIAN INDIAN", "ASIAN - VIETNAMESE", "ASIAN - OTHER", "ASIAN - FILIPINO", "ASIAN - CAMBODIAN"],
    "WHITE": ["WHITE - RUSSIAN", "WHITE - BRAZILIAN", "WHITE - OTHER EUROPEAN"],
    "BLACK/AFRICAN AMERICAN": ["BLACK/CAPE VERDEAN", "BLACK/HAITIAN", "BLACK/AFRICAN"],
    "HISPANIC OR LATINO": [
        "HISPANIC/LATINO - PUERTO RICAN", "HISPANIC/LATINO - DOMINICAN", "HISPANIC/LATINO - SALVADORAN",
        "HISPANIC/LATINO - CUBAN", "HISPANIC/LATINO - MEXICAN",
    ],
    "OTHER": [
        "MULTI RACE ETHNICITY", "MIDDLE EASTERN", "PORTUGUESE", "AMERICAN INDIAN/ALASKA NATIVE",
        "NATIVE HAWAIIAN OR OTHER PACIFIC ISLANDER", "AMERICAN INDIAN/ALASKA NATIVE FEDERALLY RECOGNIZED TRIBE",
    ],
    "UNKNOWN/NOT SPECIFIED": ["UNABLE TO OBTAIN", "PATIENT DECLINED TO ANSWER"],
}
UNKNOWN_MARITAL_STATUS = "UNKNOWN"
MAX_AGE = 105

# Reference levels left out of the research dummies.
RESEARCH_REFERENCE_LEVELS = [
    "admission_type_URGENT", "admission_location_TRANSFER FROM MED FACILITY", "insurance_Self Pay", "language_OTHER",
    "religion_NOT SPECIFIED", "marital_status_UNKNOWN (DEFAULT)", "ethnicity_UNKNOWN/NOT SPECIFIED", "gender_M",
]

# Hidden layers of the sweep: two, four and six layers, from wide to narrow.
LAYER_GRID = [
    [676, 338], [338, 169], [224, 112], [128, 64], [64, 32],
    [676, 338, 169, 84], [338, 169, 84, 42], [169, 84, 42, 24], [84, 42, 24, 12], [42, 24, 12, 6],
    [1352, 676, 338, 169, 84, 42], [676, 338, 169, 84, 42, 24], [338, 169, 84, 42, 24, 12], [169, 84, 42, 24, 12, 6],
    [84, 42, 24, 12, 6, 3],
]
