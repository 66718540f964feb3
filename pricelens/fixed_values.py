"""Word lists, patterns and catalogue that must be equal for right results.

Everything in this module is data. Patterns are written in Java regular-expression syntax and are applied to
normalised text (lower case, no accents, single spaces) unless they are said to be for upper-case text.
"""

# Default keyword categories for drives.
DRIVE_KEYWORDS = {
    "dead": ["pour pieces", "pour piece", "piece detachee", "pieces detachees", "hs", "h.s", "ne fonctionne pas",
             "ne fonctionne plus", "defectueux", "defectueuse", "en panne", "for parts", "defekt", "not working",
             "ne demarre pas", "ne demarre plus", "non fonctionnel", "a reparer", "secteurs defectueux",
             "secteur defectueux", "bad sectors", "faulty", "kaputt", "clique"],
    "smr": ["barracuda", "archive", "blue", "compute", "smr", "shingled"],
    "sas": ["sas", "scsi", "12gb/s", "12 gb/s", "12gbps"],
    "external": ["externe", "external", "usb", "usb2", "usb3", "usb-c", "usbc", "thunderbolt", "my book", "mybook",
                 "wd book", "book", "elements", "expansion", "backup plus", "easystore", "desktop drive", "game drive",
                 "xbox", "playstation", "ps4", "ps5", "portable", "g-raid", "g-tech", "g-technology", "g-drive",
                 "gdrive", "quattro", "freecom", "fantec", "mercury elite", "lacie", "extern"],
    "bundle": ["serveur nas", "nas synology", "nas qnap", "nas ugreen", "nas asustor", "nas terramaster",
               "nas buffalo", "nas netgear", "nas wd", "synology ds", "qnap ts", "rackstation", "diskstation",
               "terastation", "readynas", "linkstation", "my cloud", "mycloud", "drobo", "avec disques",
               "avec disque", "fourni avec", "nas complet", "2 baies", "4 baies", "5 baies", "6 baies", "8 baies",
               "nvr", "enregistreur", "dvr", "baie de brassage"],
    "other_device": ["adaptateur", "caddy", "dock", "docking", "hub", "switch", "onduleur", "cable", "carte raid",
                     "carte controleur", "controleur", "cle usb", "tiroir", "rack seul", "boitier seul",
                     "boitier vide", "nvme", "m.2"],
}

# Words that negate a keyword standing right after them.
NEGATION_WORDS = ["aucun", "aucune", "sans", "pas de", "zero", "no", "ohne", "keine", "non", "0"]

# Vendor reference patterns (upper-case text); a space or dash is tolerated at the break points.
REFERENCE_PATTERNS = {
    "seagate": r"(?<![A-Z0-9])ST[ \-]?(\d{4,5})[ \-]?([A-Z]{2})[ \-]?(\d{3,4}[A-Z]?)(?![A-Z0-9])",
    "wd": r"(?<![A-Z0-9])WD[ \-]?(\d{2,4})[ \-]?([A-Z]{4})(?![A-Z0-9])",
    "hgst": r"(?<![A-Z0-9])(HU[HS][ \-]?\d{6}[ \-]?AL[ENS45]\d{3}|HUS[ \-]?\d{3}T\d{1,2}T[ \-]?AL[ENS45]\d[A-Z0-9]\d)(?![A-Z0-9])",
    "toshiba_mg": r"(?<![A-Z0-9])(M[GN])(\d{2})[ \-]?([ASN])([CD])A[ \-]?(\d{1,2}T|\d{3})([A-Z0-9]{0,2})(?![A-Z0-9])",
    "toshiba_hdw": r"(?<![A-Z0-9])(HDW[A-Z])(\d)([0-9A-Z])(\d)([A-Z0-9]{0,5})(?![A-Z0-9])",
}

# Structural class of a reference outside the catalogue: letters -> (family, kind).
SEAGATE_CLASSES = {
    "VN": ("IronWolf", "accept"),
    "NE": ("IronWolf Pro", "accept"),
    "NT": ("IronWolf Pro", "accept"),
    "NM": ("Exos", "accept"),
    "DM": ("Barracuda", "smr"),
    "AS": ("Archive", "smr"),
    "VX": ("SkyHawk", "low_tier"),
    "VE": ("SkyHawk AI", "low_tier"),
}
WD_CLASSES = {
    "EFZZ": ("WD Red Plus", "accept"), "EFPX": ("WD Red Plus", "accept"),
    "EFAX": ("WD Red Plus", "accept"), "EFBX": ("WD Red Plus", "accept"),
    "FFBX": ("WD Red Pro", "accept"), "FFWX": ("WD Red Pro", "accept"),
    "FRYZ": ("WD Gold", "accept"), "FRYX": ("WD Gold", "accept"), "FRXZ": ("WD Gold", "accept"),
    "PURZ": ("WD Purple", "low_tier"), "PUZX": ("WD Purple", "low_tier"),
    "PURX": ("WD Purple", "low_tier"), "PURU": ("WD Purple", "low_tier"),
    "EDAZ": ("WD Blue/Elements", "smr"), "EAZZ": ("WD Blue", "smr"), "EZAZ": ("WD Blue", "smr"),
    "EMAZ": ("WD white label", "unverified"), "EMZZ": ("WD white label", "unverified"),
}
HGST_INTERFACES = {"E": "accept", "N": "4kn", "5": "sas", "4": "sas_4kn"}
HDW_FAMILIES = {"HDWG": "Toshiba N300", "HDWN": "Toshiba N300", "HDWT": "Toshiba S300",
                "HDWF": "Toshiba X300", "HDWE": "Toshiba X300", "HDWR": "Toshiba X300"}

# The drive catalogue.
DRIVE_CATALOGUE = {
    "accept": [
        {"family": "IronWolf", "brand": "Seagate", "refs": ["ST8000VN0022", "ST8000VN004", "ST8000VN002"]},
        {"family": "IronWolf Pro", "brand": "Seagate", "refs": ["ST8000NE0021", "ST8000NE001", "ST8000NT001"]},
        {"family": "Exos", "brand": "Seagate", "refs": ["ST8000NM0055", "ST8000NM000A", "ST8000NM017B"]},
        {"family": "WD Red Plus", "brand": "WD", "refs": ["WD80EFZZ", "WD80EFPX", "WD80EFAX", "WD80EFBX"]},
        {"family": "WD Red Pro", "brand": "WD", "refs": ["WD8003FFBX", "WD8005FFBX"]},
        {"family": "WD Gold", "brand": "WD", "refs": ["WD8004FRYZ", "WD8002FRYZ"]},
        {"family": "Ultrastar", "brand": "WD/HGST", "refs": ["HUH728080ALE600", "HUH728080ALE601", "HUS728T8TALE6L4"]},
        {"family": "Toshiba MG", "brand": "Toshiba", "refs": ["MG05ACA800E", "MG06ACA800E", "MG08ADA800E"]},
        {"family": "Toshiba N300", "brand": "Toshiba", "refs": ["HDWG480", "MN08ADA800E", "MN10ADA800S"]},
    ],
    "low_tier": [
        {"family": "SkyHawk", "brand": "Seagate", "refs": ["ST8000VX0022", "ST8000VX004", "ST8000VX010"]},
        {"family": "WD Purple", "brand": "WD", "refs": ["WD82PURZ", "WD84PURZ", "WD80PURZ", "WD80PUZX"]},
    ],
    "reject": {
        "smr": ["ST8000DM004", "ST8000DM005", "ST8000AS0002", "WD80EDAZ", "WD80EAZZ"],
        "sas": ["ST8000NM0075", "ST8000NM0065"],
        "4kn": ["ST8000NM0045"],
    },
}

# Families named without a reference: (pattern, family, brand, low tier), then brands alone.
FAMILY_HINTS = [
    (r"ironwolf ?pro", "IronWolf Pro", "Seagate", False),
    (r"iron ?wolf", "IronWolf", "Seagate", False),
    (r"\bexos\b|enterprise capacity|constellation es", "Exos", "Seagate", False),
    (r"\bred ?pro\b", "WD Red Pro", "WD", False),
    (r"\bred ?plus\b", "WD Red Plus", "WD", False),
    (r"\bwd ?red\b|western ?digital[^.]{0,20}\bred\b|\bred\b[^.]{0,20}\b(wd|western)", "WD Red", "WD", False),
    (r"\bwd ?gold\b|western ?digital[^.]{0,20}\bgold\b|\bgold\b[^.]{0,20}\b(wd|western)", "WD Gold", "WD", False),
    (r"ultrastar|\bhgst\b|\bhitachi\b", "Ultrastar", "WD/HGST", False),
    (r"\bn300\b", "Toshiba N300", "Toshiba", False),
    (r"\bmg0?\d\b|toshiba[^.]{0,20}(enterprise|entreprise)", "Toshiba MG", "Toshiba", False),
    (r"sky ?hawk", "SkyHawk", "Seagate", True),
    (r"\bpurple\b", "WD Purple", "WD", True),
]
BRAND_HINTS = [
    (r"\bseagate\b|\bsegate\b", "Seagate"),
    (r"\bwestern ?digital\b|\bwd\b", "WD"),
    (r"\btoshiba\b", "Toshiba"),
    (r"\bhgst\b|\bhitachi\b", "WD/HGST"),
]

# Drive text patterns.
CAPACITY_TB = r"(?<![\d,.])(\d{1,2})\s?(?:to|tb|t)(?![a-z0-9])"
CAPACITY_GB = r"(?<![\d,.])(\d{3,5})\s?(?:go|gb|gigas?)(?![a-z])"
COMMA_LIST = r"\d\s?,\s?\d\s?,\s?\d"
SMALL_FORM = r"2[.,]5\s?(?:\"|pouces?|inch|zoll|po\b)|2\"\s?1/2|2\s?1/2\s?(?:\"|pouces?)"
DRIVE_SSD = r"\bssd\b|\bnvme\b"
USAGE_HOURS = (r"(?<![\d,.])(\d{1,3}(?:[ .]\d{3})+|\d{3,6})\s?"
               r"(?:h\b|heures?\b|hours?\b|hrs\b|std\b|stunden|betriebsstunden)")
POWER_ON_HOURS = r"power[- ]?on[- ]?hours?\D{0,12}(\d[\d ]{2,7})"
DRIVE_LOT_PATTERNS = [
    r"\blot de (\d{1,2})\b",
    r"(?<![\d,.])(\d{1,2})\s?x\s?(?=\d{1,2}\s?(?:to|tb|t)\b)",
    r"(?:to|tb)\s?x\s?(\d{1,2})\b",
    r"(?<![\d,.])(\d{1,2})\s?(?:disques?|pieces?|pcs|unites?|stuck|drives?|hdd)\b",
    r"(?<![\d,.\"'])(\d{1,2})\s?x?\s+(?:seagate|segate|wd|western|toshiba|hgst|hitachi|exos|ironwolf|ultrastar)\b",
]
NAS_MODEL = r"\b(?:ds|rs|dxp)\d{3,4}[a-z+]*\b|\bts-?\d{3,4}[a-z]*\b"
EXOS_NAME = r"\b7e\s?(\d{1,2})(000)?\b|\bexos\s?x(\d{2})\b"
LOT_TOTAL = (r"(?:\btotal\b|\bsoit\b|\bcumul[ée]*\b|=)\s*[:(]?\s*(\d{1,2})\s?(?:to|tb)\b"
             r"|(\d{1,2})\s?(?:to|tb)\s+(?:au total|en tout|cumul[ée]s?)")
GENERIC_OFFER = (r"plusieurs (modeles|capacites|tailles|disques|references)|multiples? capacites"
                 r"|differentes capacites|au choix|capacites? disponibles")

# PC text patterns.
CPU_INTEL = r"(?<![a-z0-9])(?:core\s*)?i([3579])[\s\-]?(\d{4,5})([a-z]{0,2})(?![a-z0-9])"
CPU_INTEL_GEN = (r"(?<![a-z0-9])(?:core\s*)?i([3579])(?![a-z0-9\-])[^.,;()]{0,25}?(\d{1,2})\s?"
                 r"(?:e|eme|th|st|nd|rd)?\s?(?:gen\b|generation)")
CPU_RYZEN = r"\bryzen\s*([3579])\s*(pro\s*)?(\d{4})([a-z]{0,2})(?![a-z0-9])"
CPU_LOW_END = r"\b(celeron|pentium|athlon)\b"
CPU_BARE_TIER = r"(?<![a-z0-9])(?:core\s*)?i([3579])(?![a-z0-9\-])"
CPU_TIER_POINTS = {"celeron": -3, "pentium": -2, "athlon": -2, "3": 0, "5": 2, "7": 3, "9": 4}
RYZEN_GENERATIONS = {"1": 7, "2": 8, "3": 9, "4": 10, "5": 11, "6": 12, "7": 13, "8": 14}
MEMORY_GB = r"(?<![\d,.])(\d{1,4})\s?(?:go|gb)(?![a-z])"
MEMORY_TB = r"(?<![\d,.])(\d)\s?(?:to|tb)(?![a-z0-9])"
RAM_WORDS = r"\bram\b|ddr[345]?|memoire|sodimm|so-dimm"
STORAGE_WORDS = r"\bssd\b|nvme|\bhdd\b|disque|stockage|m\.?2\b|sata|emmc"
CONTEXT_BREAK = r"[-|,/;•+()]"
KIND_NVME = r"\bnvme\b|m\.?2\b"
KIND_SSD = r"\bssd\b"
KIND_HDD = r"\bhdd\b|disque dur"
NO_STORAGE = r"\b(?:sans|no|ohne|pas de)\s+(?:ssd|disque|stockage|hdd|nvme)"
NO_RAM = r"\b(?:sans|no|ohne|pas de)\s+(?:ram|memoire|barrette)"
NO_PSU = r"\b(?:sans|no|ohne|pas de)\s+(?:alim|alimentation|chargeur|bloc|adaptateur secteur|cable)"
BAREBONE = r"\bbarebone\b"
SCREEN_BUNDLE = r"\becrans?\b|\bmoniteur\b|\bclavier\b"
CPU_ALONE = r"^\s*(?:processeur|cpu|proc)\b"
WANTED_AD = r"^\s*(?:recherche|cherche|achete|achat|je cherche)\b"
PC_LOT_PATTERNS = [
    r"\blot de (\d{1,2})\b",
    r"(?<![\d,.])(\d{1,2})\s?(?:pcs|pieces|unites|ordinateurs|mini[ -]?pcs?|exemplaires)\b",
    r"(?:^|\s)x\s?(\d{1,2})\b",
]
PC_MINI_WORDS = ["micro", "mini", "tiny", "usff", "1l"]
PC_LOW_FLAGS = ["cpu_unknown", "family_unknown", "barebone", "bundle"]
PC_FLAG_NOTES = {
    "cpu_unknown": "demander le processeur exact",
    "cpu_gen_assumed": "génération du CPU déduite du châssis, à confirmer",
    "bundle": "vendu avec écran ou clavier : prix non comparable",
    "ram_unknown": "demander la RAM",
    "storage_unknown": "demander le stockage",
    "family_unknown": "châssis hors catalogue",
    "barebone": "vendu sans RAM ni disque",
    "no_storage": "vendu sans disque",
    "no_ram": "vendu sans RAM",
    "no_psu": "vendu sans alimentation",
}
KEYWORDS_FLAG_NOTES = {"family_unknown": "variante non précisée dans l'annonce : à confirmer"}
KEYWORDS_LOT = r"\blot de (\d{1,2})\b"

# Embedded JSON island, result cards and item pages.
JSON_ISLAND = r"(?s)<script id=\"__NEXT_DATA__\"[^>]*>(.*?)</script>"
CARD_TAG = r"(?s)<a\s[^>]*data-testid=\"product-item-id-(\d+)--overlay-link\"[^>]*>"
CARD_PRICES = r"(?U),\s*([\d\s.,]+?)\s*€(?:,\s*([\d\s.,]+?)\s*€)?\s*$"
CARD_PAIR = r"(?U),\s*([A-ZÉÈ][\wéèêàç' ]{1,20}):\s*([^,]*)$"
PRODUCT_JSON = r"(?s)<script[^>]*type=\"application/ld\+json\"[^>]*>(.*?)</script>"
ITEM_RESERVED = r"\\?\"is_reserved\\?\":\s*true"
ITEM_REPUTATION = r"\\?\"feedback_reputation\\?\":\s*([0-9.]+)"
ITEM_FEEDBACK = r"\\?\"feedback_count\\?\":\s*(\d+)"

# Forum topics. The last group is applied to raw text, the rest to normalised text.
TOPIC_SALE = r"\bvds\b|\bvend[sre]?\b|\bvente\b"
TOPIC_AGGREGATE = r"\btopic\b|\btopik\b"
TOPIC_SHIP_IN = (r"fdp\s*-?\s*in\b|fdpin\b|€\s*in\b|port\s+(?:inclus|compris|offert)|fdp\s+(?:inclus|compris|offert)"
                 r"|livraison\s+(?:incluse|offerte)")
TOPIC_SHIP_YES = r"\benvoi\b|\bexp[ée]di|colissimo|mondial relay|relais|\bfdp\b|\blivraison\b"
TOPIC_HAND_ONLY = (r"(?:main propre|\bmp\b|remise en main propre)\s+(?:uniquement|seulement)|pas d.envoi"
                   r"|aucun envoi")
TOPIC_SOLD = r"[\[(]\s*vendue?s?\s*[\])]|\bvendue?s?\s*(?:!|$)|^\s*vendue?s?\b"
TOPIC_PENDING = r"[\[(]\s*(?:r[ée]serv[ée]e?s?|resa)\s*[\])]|\br[ée]serv[ée]e?s?\s*(?:!|$)"
TOPIC_PRICE_IN = r"(\d{1,6})\s*(?:€|e|euros?)?\s*(?:fdp\s*)?-?\s*in\b"
TOPIC_PRICE_WORD = r"\bprix\b|\bpx\b|€\s*(?:out|in)\b|\bfdp\b"
TOPIC_SEPARATOR = r"^\s*[-=_*~#]{5,}"
TOPIC_PRICE = r"(?iU)(?<![\d,.])(\d{1,3}(?:[\s.]\d{3})+|\d{1,6})(?:[,.]\d{1,2})?\s*(?:€|euros?\b|eur\b)"
TOPIC_PRICE_LABEL = r"(?iU)\bprix\s*(?:demand[ée]\s*)?:?\s*(\d{1,3}(?:[\s.]\d{3})+|\d{1,6})\b"
TOPIC_STRUCK = r"~~.*?~~"
TOPIC_DATE = r"(\d{2}-\d{2}-\d{4})\D+(\d{2}:\d{2})"
TOPIC_TRANSACTIONS = r"Transactions\s*\((\d+)\)"
