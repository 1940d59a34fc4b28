"""Fixed values that results depend on: alphabets, look-alikes, vocabularies, templates."""

CYRILLIC = "АБВГҒДЕЁЖЗИӢЙКҚЛМНОПРСТУӮФХҲЦЧҶШЩЪЫЬЭЮЯ"
LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
NAME_LETTERS = "A-Za-zА-Яа-яЁёӢӣӮӯҚқҒғҲҳҶҷ"

# Cyrillic letters and the Latin letters that look like them.
HOMOGLYPHS = ("АаВЕеЅѕКМНОоРрСсТХхУуІі", "AaBEeSsKMHOoPpCcTXxYyIi")
# Letters read for digits: in document numbers (text), in machine-readable lines, in zone reads.
NUMBER_DIGITS = ("ЗзZЅSбВBIlІ", "33255688111")
MRZ_DIGITS = ("ODQILZSGB", "000112568")
ZONE_DIGITS = ("OQDILZSGB", "000112568")
MRZ_LETTERS = ("012568", "OIZSGB")
MRZ_SEX = ("NHPE", "MMFF")
FILLERS = "KLCESIX"
STATE = "TJK"

TRANSLIT = {
    "А": "A", "Б": "B", "В": "V", "Г": "G", "Ғ": "GH", "Д": "D", "Е": "E", "Ё": "YO", "Ж": "ZH", "З": "Z", "И": "I", "Ӣ": "I", "Й": "Y",
    "К": "K", "Қ": "Q", "Л": "L", "М": "M", "Н": "N", "О": "O", "П": "P", "Р": "R", "С": "S", "Т": "T", "У": "U", "Ӯ": "U", "Ф": "F",
    "Х": "KH", "Ҳ": "H", "Ц": "TS", "Ч": "CH", "Ҷ": "J", "Ш": "SH", "Щ": "SHCH", "Ъ": "", "Ы": "Y", "Ь": "", "Э": "E", "Ю": "YU", "Я": "YA",
}
SKELETON = ("БВГҒДЖЗКҚЛМНПРСТФХҲЦЧҶШЩ", "BVGGDJZKKLMNPRSTFHHSJJSS")
LATIN_SKELETON = (("KH", "H"), ("SH", "S"), ("CH", "J"), ("TS", "S"), ("Q", "K"), ("C", "S"), ("X", "H"), ("W", "V"))
# Letters that differ by a hook only.
HOOKS = {"К": "Қ", "Қ": "К", "Х": "Ҳ", "Ҳ": "Х", "Г": "Ғ", "Ғ": "Г", "Ч": "Ҷ", "Ҷ": "Ч"}
# Latin spellings, longest first, and the letters that each may stand for.
LATIN_TOKENS = [
    ("SHCH", "Щ"), ("GH", "Ғ"), ("ZH", "Ж"), ("KH", "Х"), ("TS", "Ц"), ("CH", "Ч"), ("SH", "Ш"), ("YO", "Ё"), ("YU", "Ю"), ("YA", "Я"),
    ("A", "А"), ("B", "Б"), ("V", "В"), ("G", "Г"), ("D", "Д"), ("E", "ЕЭ"), ("Z", "З"), ("I", "ИӢ"), ("Y", "ЙЫ"), ("K", "К"), ("Q", "Қ"),
    ("L", "Л"), ("M", "М"), ("N", "Н"), ("O", "О"), ("P", "П"), ("R", "Р"), ("S", "С"), ("T", "Т"), ("U", "УӮ"), ("F", "Ф"), ("H", "Ҳ"), ("J", "Ҷ"),
]
# Letters that recognition swaps for one another.
CONFUSION_GROUPS = ["НПИЙ", "АЛД", "БВЬ", "ОСЭФ", "ЕСЁ", "КҚХҲ", "ГҒТР", "ЧҶУӮ", "ШЩЦ", "ИӢ", "ЗЭВ", "ЖК", "МН", "ЛП", "РЯҒ"]
MARITAL = ["SINGLE", "MARRIED", "DIVORCED", "WIDOWED"]
# Words of English labels.
LABEL_WORDS = [
    "surname", "given", "names", "name", "fathers", "father", "sex", "nationality", "citizenship", "date", "of", "birth", "place", "issue",
    "expiry", "document", "id", "no", "number", "national", "authority", "address", "marital", "status", "blood", "group", "and", "rh",
    "factor", "holder", "signature", "tax", "payer", "republic", "tajikistan", "identity", "card",
]
# Spellings of the citizenship and of the sex that are accepted.
CITIZENSHIPS = ["TJK", "TAJIKISTAN", "ТОҶИКИСТОН", "ТОЧИКИСТОН"]
SEX_MALE, SEX_FEMALE = ["M", "М", "МУЖ", "MALE"], ["F", "Ж", "ЗАН", "FEMALE"]
# Shapes of names in capitals, and what marks a line as a label instead. НИШОН is the beginning and a part of names too: it counts as
# a word of its own or at the beginning of one as the labels have it.
CYRILLIC_NAME = f"^[{CYRILLIC}]{{2,}}(?:[ '-][{CYRILLIC}]+)*\\z"
LATIN_NAME = r"^[A-Z]{2,}(?:[ '-][A-Z]+)*\z"
NAME_LABELS = (
    r"НАСАБ|^НОМ\z|НОМИ|ПАДАР|ША[ҲХ]РВАНД|[ҶЧ]ИНС|ТАВАЛЛУД|МА[ҚК]ОМИ|(?<!\p{L})НИШОН(?:[ИӢ]|(?!\p{L}))|ШИНОСНОМА|РА[ҚК]АМИ|SURNAME|FATHER|NATIONALITY|BIRTH|AUTHORITY|"
    r"ADDRESS|DOCUMENT|ISSUE|EXPIRY|^NAME\z|^SEX\z"
)
NAME_FIELDS = ["surname", "givenNames", "fatherName"]
FIELDS = [
    "surname", "givenNames", "fatherName", "sex", "birthDate", "birthPlace", "citizenship", "documentNumber", "nationalIdNumber",
    "issueDate", "expiryDate", "authority", "address", "maritalStatus", "bloodGroup", "taxId",
]

# (source, pattern, excluded pattern, x, y) of the labels on the front template.
ANCHORS = [
    ("tajik", "насаб", None, 665, 306), ("english", "surname", None, 665, 306), ("tajik", "^ном(?!и)", None, 667, 461), ("english", "name", "father|surname", 667, 461),
    ("tajik", "падар", None, 669, 612), ("english", "father", None, 879, 612), ("tajik", r"санаи\s*таваллуд", None, 1080, 760), ("english", "birth", "place", 1081, 791),
    ("tajik", r"[ҷч]ои\s*та", None, 1457, 758), ("tajik", "^[ҷч]инс", None, 671, 768), ("english", r"^sex\z", None, 669, 798), ("tajik", "ша[ҳх]рванд", None, 813, 744),
    ("tajik", "яго", None, 1459, 878), ("english", "national", None, 1458, 910), ("tajik", "о[ғг]ози", None, 672, 884), ("english", "issue", None, 672, 919),
    ("tajik", "ан[ҷч]оми", None, 1082, 882), ("english", "expiry", None, 1082, 915), ("tajik", r"ра[қк]ами\s*шиносн", None, 93, 1067), ("english", "document", None, 402, 1067),
]
# (field, part, x0, y0, x1, y1) of the values on the front and back templates.
FRONT_BOXES = [
    ("surname", "cyrillic", 655, 333, 1120, 391), ("surname", "latin", 655, 384, 1120, 440), ("givenNames", "cyrillic", 657, 486, 1120, 542), ("givenNames", "latin", 656, 534, 1120, 590),
    ("fatherName", "cyrillic", 657, 640, 1120, 698), ("fatherName", "latin", 658, 689, 1120, 747), ("sex", "value", 660, 820, 790, 872), ("citizenship", "value", 800, 820, 1010, 872),
    ("birthDate", "value", 1080, 816, 1330, 870), ("birthPlace", "value", 1450, 815, 1790, 868), ("issueDate", "value", 660, 946, 900, 1000), ("expiryDate", "value", 1078, 942, 1320, 996),
    ("nationalIdNumber", "value", 1455, 938, 1800, 992), ("documentNumber", "value", 80, 1100, 500, 1165),
]
BACK_SIZE = (1800, 1206)
BACK_MRZ = (96, 1697, (825.5, 911, 1000.5))
BACK_ADDRESS = {"left": 560, "right": 1720, "top": 188, "pitch": 44, "height": 52, "lines": 4}
BACK_BOXES = [
    ("maritalStatus", "cyrillic", 560, 472, 1040, 530), ("maritalStatus", "latin", 560, 472, 1040, 530), ("bloodGroup", "value", 1046, 476, 1420, 526),
    ("taxId", "value", 1435, 474, 1780, 534), ("authority", "cyrillic", 560, 560, 1760, 614),
]
# (field, x, y, width, height) of values as shares of the card.
FIXED_ZONES = [
    ("birthDate", 0.585, 0.69, 0.15, 0.055), ("issueDate", 0.365, 0.79, 0.135, 0.055), ("expiryDate", 0.585, 0.795, 0.15, 0.055),
    ("nationalIdNumber", 0.775, 0.8, 0.205, 0.055), ("documentNumber", 0.04, 0.895, 0.25, 0.06),
]
# Labels of the layout fields; AB stands for an ASCII word boundary.
FIELD_LABELS = {
    "surname": ["ABsurnameAB", "ABнасабAB"], "givenNames": ["given names?", r"^ном(?:\s*/|\s*:)"], "fatherName": ["father.?s? name", "номи падар"], "sex": ["^sexAB", "^[ҷч]инсAB"],
    "birthDate": ["date of birth", "санаи таваллуд"], "birthPlace": ["place of birth", "[ҷч]ои таваллуд"], "citizenship": ["nationality", "citizenship", "ша[ҳх]рванд"],
    "documentNumber": [r"document(?: id)? no\.?", "ра[қк]ами? шиноснома"], "nationalIdNumber": ["national id", "ра[қк]ами ягона"], "issueDate": ["date of issue", "санаи додан"],
    "expiryDate": ["date of expiry", "му[ҳх]лати амал"],
}
# Capitals of the names in a card's text.
CAPITALS = "А-ЯЁЎҚҒҲҶӢӮ"
# Labels in a card's text, hooks kept or lost in recognition.
SURNAME_LABEL, GIVEN_LABEL = "насаб|surname", "^ном/"
FATHER_LABELS = [r"номи\s*па[а-яёa-z]{2,4}", r"father.?s?\s*name"]
PLACE_LABELS = [r"[чцҷ]ои\s*таваллуд", r"place\s*of\s*birth"]
NUMBER_LABELS = [r"ра[кқ]ами?\s*шиноснома", r"document\s*(id\s*)?(no|№)\.?"]
CARD_MARKERS = ["шиноснома", r"identity\s*card", r"republic\s*of\s*tajikistan", "то[чц]икистон"]
TEXT_LABEL_LINES = [
    "насаб", "surname", r"номи\s*па[а-яёa-z]{2,4}", "father", "[чҷ]инс", "шаҳрванд", "таваллу", r"(?<![a-z0-9_])sex(?![a-z0-9_])", r"[чцҷ]ои\s*таваллуд",
    r"place\s*of(\s*birth)?", r"ра[кқ]ами?\s*шиноснома", r"ра[кқ]ами\s*ягонаи", r"document\s*(id\s*)?(no|№)", "holder", "имзои", "ма[кқ]оми", "authority",
    r"date\s*of\s*(birth|issue|expiry)", r"national\s*id", r"вазъи\s*оилав", r"marital\s*status", "гур[ӯу][хҳ]и", r"blood\s*group", "^ном/", "шиноснома",
    r"identity\s*card", "то[чц]икистон", r"republic\s*of\s*tajikistan", r"(?<![a-z0-9_])[1i]d\s*number(?![a-z0-9_])", "нишон[иӣ]",
    r"(?<![a-z0-9_])a?ddress(?![a-z0-9_])", r"father.?s?\s*name",
]
# Lines of a page that are labels and no values.
LINE_LABELS = (
    "surname|насаб|given names?|ном(?:и падар)?|father|sex|ҷинс|чинс|date of birth|таваллуд|place of birth|nationality|шаҳрванд|citizenship|document(?: id)? no|"
    "рақами? шиноснома|id number|national id|authority|мақоми|address|нишон[иӣ]|date of issue|date of expiry|marital|blood group"
)
# What a value may not hold, being a label's own text.
VALUE_LABELS = (
    r"насаб|surname|номи|падар|падap|napap|father|^номAB|^(name|мате|mate|nате|наме)\z|birth|таваллуд|санаи|document|рақами|раками|шиноснома|nationality|"
    r"authority|мақоми|address|нишон|issue|expiry|place\s*of|^sex\z|чинс"
)
