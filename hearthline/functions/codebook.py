"""Fixed values that must be equal to the published study's to get equal results."""

# Schooling code -> years, child and parent tables (codes 1..11).
SCHOOLING_YEARS = [0, 3, 4, 6, 9, 12, 12, 15, 16, 19, 22]
# Schooling code -> years, father and spouse (codes 1..17).
SCHOOLING_YEARS_RELATIVE = [0, 3, 6, 9, 11, 12, 12, 12, 15, 15, 16, 16, 19, 19, 22, 22, 16]
# Schooling code -> years, couple respondent (codes 1..16).
SCHOOLING_YEARS_RESPONDENT = [0, 6, 9, 11, 12, 12, 12, 15, 15, 16, 16, 19, 19, 22, 22, 16]
# Schooling code -> years, nine-level list.
SCHOOLING_YEARS_NINE = [0, 6, 9, 12, 12, 15, 16, 19, 22]
# Schooling code -> years, spouse in the earlier wave (codes 1..11).
SCHOOLING_YEARS_SPOUSE_EARLY = [0, 3, 3, 6, 9, 12, 11, 14, 16, 19, 22]
# Income band code -> yearly amount (codes 1..12).
INCOME_BAND_AMOUNT = [0, 1000, 2500, 7500, 15000, 25000, 40000, 75000, 125000, 175000, 250000, 500000]
# Codes that stand for a missing answer.
MISSING_CODES = [997, 999]
# Unit repair of a home's total value, in 10 000 currency units.
TOTAL_VALUE_RULES = [(">=", 1000.0, "divide", 10000.0), (">", 500.0, "set", 500.0)]
# Unit repair of a price per square metre, in 1 000 currency units.
UNIT_PRICE_RULES = [(">", 50.0, "divide", 1000.0)]
# Unit repair of a gifted home's value.
GIFT_VALUE_RULES = [(">", 300.0, "divide", 1000.0)]
# Unit repair of a couple's home value.
COUPLE_VALUE_RULES = [(">", 1000.0, "divide", 10000.0)]
# Home acquisition codes that keep a label of their own; all others are "Other".
ACQUISITION_LABELS = {1: "Market", 2: "Work Unit", 6: "Self-built", 8: "Compensation"}
# Job rank groups.
JOB_RANK = {1: "worker", 2: "low", 3: "low", 4: "high", 5: "high", 6: "low", 7: "low", 8: "low", 9: "high"}
# Employment sector codes of status 3 that are public, private; owner codes that are public.
PUBLIC_SECTORS = ["1", "2", "3", "4", "5", "7"]
PRIVATE_SECTORS = ["8", "9"]
PUBLIC_OWNERS = ["1", "2"]
# Schooling too short for a level (level -> years, strict comparison?).
DROPOUT_LIMITS = {"primary": (6, True), "middle": (6, False), "high": (9, False), "college": (12, False)}
# Job labels of the drill-down, merged to five sectors.
JOB_SECTOR = {
    "1 Own Agricultural Production and Business": "1 Agricultural",
    "2 Agricultural Employment": "1 Agricultural",
    "6 Farmer": "1 Agricultural",
    "8 Rural Collective Economic Organization": "1 Agricultural",
    "4 Non-agricultural self-employment": "2 Private",
    "3 Non-agricultural Employment": "2 Private",
    "3 NGO": "2 Private",
    "5 Individual Firm": "2 Private",
    "7 Individual Household": "2 Private",
    "9 Other": "2 Private",
    "3 Private Controlled Firm": "2 Private",
    "4 Hongkong/Macao/Taiwan Controlled Firm": "2 Private",
    "5 Foreign Controlled Firm": "2 Private",
    "2 Collective Controlled Firm": "2 Private",
    "6 Other": "2 Private",
    "1 State Controlled Firm": "3 State Controlled Firm",
    "2 Public Institution": "4 Public institution",
    "6 Army": "4 Public institution",
    "1 Government": "5 Government",
    "5 Unpaid Household Business Help": "2 Private",
}
# Labels at which the drill-down goes one column further.
JOB_EMPLOYED = ["2 Agricultural Employment", "3 Non-agricultural Employment"]
JOB_FIRM = ["4 Firm"]
