"""Fixed values that results depend on: word lists, rules and character maps."""

from __future__ import annotations

import unicodedata

# Devanagari letters to Latin.
DEVANAGARI = {
    "अ": "a", "आ": "aa", "इ": "i", "ई": "ee", "उ": "u", "ऊ": "oo", "ऋ": "ri", "ए": "e", "ऐ": "ai", "ओ": "o", "औ": "au",
    "क": "k", "ख": "kh", "ग": "g", "घ": "gh", "ङ": "ng", "च": "ch", "छ": "chh", "ज": "j", "झ": "jh", "ञ": "ny",
    "ट": "t", "ठ": "th", "ड": "d", "ढ": "dh", "ण": "n", "त": "t", "थ": "th", "द": "d", "ध": "dh", "न": "n",
    "प": "p", "फ": "ph", "ब": "b", "भ": "bh", "म": "m", "य": "y", "र": "r", "ल": "l", "व": "v",
    "श": "sh", "ष": "sh", "स": "s", "ह": "h",
    "ा": "a", "ि": "i", "ी": "ee", "ु": "u", "ू": "oo", "ृ": "ri", "े": "e", "ै": "ai", "ो": "o", "ौ": "au",
    "्": "", "ं": "n", "ँ": "n", "ः": "h",
    "०": "0", "१": "1", "२": "2", "३": "3", "४": "4", "५": "5", "६": "6", "७": "7", "८": "8", "९": "9",
}

# Whole-word expansions, applied in this order.
EXPANSIONS = [
    (r"pvt\s+ltd", "private limited"), ("pvt", "private"), ("ltd", "limited"), ("inc", "incorporated"), ("co", "company"),
    ("corp", "corporation"), ("llc", "limited liability company"), ("llp", "limited liability partnership"), ("ste", "suite"),
    ("apt", "apartment"), ("rd", "road"), ("st", "street"), ("ave", "avenue"), ("blvd", "boulevard"), ("dr", "drive"),
]

# Expansions of the variants that define but never apply them; an option, off by default.
EXPANSIONS_INDIC = [(r"प्रा\s*लि", "private limited"), ("लिमिटेड", "limited"), ("प्राइवेट", "private"), ("कंपनी", "company"), ("एलएलपी", "llp")]

# US states, and the federal district that only one variant counts.
STATES = (
    "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ "
    "NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY"
).split()
DISTRICT = "DC"

# Words of names that tell nothing.
GENERIC = (
    "inc corp llc ltd group co company school public center services service pvt limited optical studio "
    "care international holding holdings the and of in"
).split()

# Stop words of the main variant's retrieval.
STOP_WORDS = (
    "limited private ltd pvt llc inc corp corporation company co enterprises enterprise group holdings holding "
    "partners associates industries industry ventures venture solutions services service international intl llp plc "
    "gmbh sa srl bv ag sarl sas sasu eurl sci snc ste societe amicale club "
    "street st road rd avenue ave lane ln drive dr suite floor fl building bldg near opp opposite "
    "post box po highway hwy block blk sector sec plot shop flat room no unit "
    "rue boulevard bd blvd chemin route rte impasse allee place cedex "
    "the and of in for at by to on from with de du des la le les et en d"
).split()

# Tokens that the phonetic keys skip.
PHONETIC_STOPS = (
    "PVT LTD LIMITED PRIVATE INC INCORPORATED CORP CORPORATION CO COMPANY LLC LLP SA SAS SARL GMBH STORE SHOP ENTERPRISE "
    "ENTERPRISES SERVICES SOLUTIONS INDUSTRIES TRADING TRADERS"
).split()

# Scripts in the order that decides ties, as ranges of code points.
SCRIPTS = {
    "Latin": [(0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "Devanagari": [(0x900, 0x97F)],
    "Arabic": [(0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF)],
    "Cyrillic": [(0x400, 0x4FF), (0x500, 0x52F)],
    "CJK": [(0x4E00, 0x9FFF), (0x3040, 0x30FF), (0xAC00, 0xD7AF)],
    "Greek": [(0x370, 0x3FF)],
    "Hebrew": [(0x590, 0x5FF)],
}
DOMINANT = 0.7


def accents() -> tuple[str, str]:
    """Lower-case Latin letters whose decomposition is one ASCII letter and marks, and those letters."""
    source, target = "", ""
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]:
        base = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(base) == 1 and base != chr(code):
            source, target = source + chr(code), target + base
    return source, target
