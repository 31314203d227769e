"""Code point sets, names, phrases, hints and limits. Ranges are inclusive (first, last)."""

from __future__ import annotations

import unicodedata

# Invisible code points that are stripped.
STRIP = [
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E),
    (0x2060, 0x2064), (0x2066, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB),
]
VS_SUPPLEMENT = [(0xE0100, 0xE01EF)]
TAGS = [(0xE0020, 0xE007F)]
TAG_BLOCK = [(0xE0001, 0xE007F)]
PRIVATE_USE = [(0xE000, 0xF8FF), (0xF0000, 0xFFFFD), (0x100000, 0x10FFFD)]
NONCHARACTERS = [(0xFDD0, 0xFDEF), *[(p * 0x10000 + 0xFFFE, p * 0x10000 + 0xFFFF) for p in range(17)]]
RESERVED = [(0x2065, 0x2065), (0xFFF0, 0xFFF8), (0xE0000, 0xE0000), (0xE0080, 0xE00FF), (0xE01F0, 0xE0FFF)]
SPACES = [(0x00A0, 0x00A0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
BIDI = [(0x061C, 0x061C), (0x200E, 0x200F), (0x202A, 0x202E), (0x2066, 0x2069)]
BIDI_KEPT = [(0x061C, 0x061C), (0x200E, 0x200F), (0x2066, 0x2069)]
ZERO_WIDTH = [(0x180E, 0x180E), (0x200B, 0x200D), (0x2060, 0x2060), (0xFEFF, 0xFEFF)]
EMOJI_GLUE = [(0x200D, 0x200D), (0xFE0E, 0xFE0F)]
JOINERS = [(0x200C, 0x200D)]
ORTHOGRAPHIC_CF = [(0x0600, 0x0605), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x08E2, 0x08E2), (0x110BD, 0x110BD), (0x110CD, 0x110CD)]
MONGOLIAN_VS = [(0x180B, 0x180D), (0x180F, 0x180F)]
KHMER_VOWELS = [(0x17B4, 0x17B5)]
HANGUL_FILLERS = [(0x115F, 0x1160), (0x3164, 0x3164), (0xFFA0, 0xFFA0)]
VS = [(0xFE00, 0xFE0F)]
VS_CJK = [(0xFE00, 0xFE0D)]
GLUE = [*EMOJI_GLUE, *VS_SUPPLEMENT, *VS, *MONGOLIAN_VS, *JOINERS, *TAGS, *KHMER_VOWELS, *HANGUL_FILLERS]
#: Controls and the script beside which they are part of the text.
LAYOUT = [((0x13430, 0x1343F), (0x13000, 0x143FF)), ((0x1BCA0, 0x1BCA3), (0x1BC00, 0x1BCA3)), ((0x1D173, 0x1D17A), (0x1D100, 0x1D1FF))]
EMOJI_BASE = [
    (0x23, 0x23), (0x2A, 0x2A), (0x30, 0x39), (0xA9, 0xA9), (0xAE, 0xAE), (0x2122, 0x2122), (0x2190, 0x27BF), (0x2B00, 0x2BFF),
    (0x3030, 0x3030), (0x303D, 0x303D), (0x3297, 0x3297), (0x3299, 0x3299), (0x1F000, 0x1FAFF),
]
CJK = [(0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)]
MONGOLIAN = [(0x1800, 0x18AF)]
JAMO = [(0x1100, 0x11FF), (0x3131, 0x318E), (0xA960, 0xA97C), (0xD7B0, 0xD7C6), (0xFFA1, 0xFFDC)]
#: Format characters of Unicode 15.1, pinned so that engines agree.
FORMAT = [
    (0x00AD, 0x00AD), (0x0600, 0x0605), (0x061C, 0x061C), (0x06DD, 0x06DD), (0x070F, 0x070F), (0x0890, 0x0891), (0x08E2, 0x08E2), (0x180E, 0x180E), (0x200B, 0x200F),
    (0x202A, 0x202E), (0x2060, 0x2064), (0x2066, 0x206F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB), (0x110BD, 0x110BD), (0x110CD, 0x110CD), (0x13430, 0x1343F),
    (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0001, 0xE0001), (0xE0020, 0xE007F),
]
#: Blocks whose letters and marks join, by group.
JOINING_BLOCKS = {"arabic": (0x0600, 0x08FF), "indic": (0x0900, 0x0DFF), "south-asian": (0x0F00, 0x109F), "khmer": (0x1780, 0x17FF), "mongolian": (0x1800, 0x18AF)}
# Look-alikes and the letters they imitate; the full-width alphabet follows by rule.
CONFUSABLES = {
    0x0410: "A", 0x0412: "B", 0x0415: "E", 0x041A: "K", 0x041C: "M", 0x041D: "H", 0x041E: "O", 0x0420: "P", 0x0421: "C", 0x0422: "T", 0x0425: "X", 0x0430: "a", 0x0435: "e", 0x043E: "o", 0x0440: "p", 0x0441: "c", 0x0443: "y", 0x0445: "x", 0x0456: "i",
}
CONFUSABLES |= {0xFF21 + i: chr(0x41 + i) for i in range(26)} | {0xFF41 + i: chr(0x61 + i) for i in range(26)}
FLAG, TAG_END = 0x1F3F4, 0xE007F
OPENERS, POP = (0x202A, 0x202B, 0x202D, 0x202E), 0x202C
EMBEDDINGS = (0x202A, 0x202B)

# Names shown for code points.
NAMES = {
    0x00A0: "NO-BREAK SPACE", 0x00AD: "SOFT HYPHEN", 0x034F: "COMBINING GRAPHEME JOINER", 0x061C: "ARABIC LETTER MARK", 0x180E: "MONGOLIAN VOWEL SEPARATOR",
    0x180F: "MONGOLIAN FREE VARIATION SELECTOR FOUR", 0x2002: "EN SPACE", 0x2003: "EM SPACE", 0x2009: "THIN SPACE", 0x200A: "HAIR SPACE", 0x200B: "ZERO WIDTH SPACE",
    0x200C: "ZERO WIDTH NON-JOINER", 0x200D: "ZERO WIDTH JOINER", 0x200E: "LEFT-TO-RIGHT MARK", 0x200F: "RIGHT-TO-LEFT MARK", 0x202A: "LEFT-TO-RIGHT EMBEDDING",
    0x202B: "RIGHT-TO-LEFT EMBEDDING", 0x202C: "POP DIRECTIONAL FORMATTING", 0x202D: "LEFT-TO-RIGHT OVERRIDE", 0x202E: "RIGHT-TO-LEFT OVERRIDE", 0x202F: "NARROW NO-BREAK SPACE",
    0x2060: "WORD JOINER", 0x2061: "FUNCTION APPLICATION", 0x2062: "INVISIBLE TIMES", 0x2063: "INVISIBLE SEPARATOR", 0x2064: "INVISIBLE PLUS", 0x2066: "LEFT-TO-RIGHT ISOLATE",
    0x2067: "RIGHT-TO-LEFT ISOLATE", 0x2068: "FIRST STRONG ISOLATE", 0x2069: "POP DIRECTIONAL ISOLATE", 0x3000: "IDEOGRAPHIC SPACE", 0x3164: "HANGUL FILLER",
    0xFE0E: "VARIATION SELECTOR-15", 0xFE0F: "VARIATION SELECTOR-16", 0xFEFF: "ZERO WIDTH NO-BREAK SPACE", 0xFFA0: "HALFWIDTH HANGUL FILLER",
}

INVISIBLE_KINDS = ("strip", "zwj_family", "variation_selector", "tag_chars", "private_use", "other_cf", "reserved_ignorable", "noncharacter")


def category_ranges(first: int, last: int, major: str) -> list[tuple[int, int]]:
    """Ranges of the block's code points whose general category starts with one of ``major``."""
    out: list[list[int]] = []
    for cp in range(first, last + 1):
        if unicodedata.category(chr(cp))[0] in major:
            if out and out[-1][1] == cp - 1:
                out[-1][1] = cp
            else:
                out.append([cp, cp])
    return [(a, b) for a, b in out]


JOINING = {name: category_ranges(a, b, "LM") for name, (a, b) in JOINING_BLOCKS.items()}
MONGOLIAN_LETTERS = category_ranges(0x1800, 0x18AF, "L")
KHMER_LETTERS = category_ranges(0x1780, 0x17FF, "L")
#: All code points that some rule may strip or replace, without and with look-alikes.
SUSPICIOUS = [*STRIP, *VS_SUPPLEMENT, *TAG_BLOCK, *PRIVATE_USE, *NONCHARACTERS, *RESERVED, *SPACES, *FORMAT]
SUSPICIOUS_AGGRESSIVE = [*SUSPICIOUS, *[(c, c) for c in CONFUSABLES]]


def regex_class(ranges: list[tuple[int, int]]) -> str:
    """A Java regex class of the ranges."""
    merged: list[list[int]] = []
    for a, b in sorted(ranges):
        if merged and a <= merged[-1][1] + 1:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    inside = "[" + "".join(f"\\x{{{a:X}}}" if a == b else f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in merged) + "]"
    # Java tries one range after the other: a code point below all of them is told by one comparison
    return f"[\\x{{{merged[0][0]:X}}}-\\x{{10FFFF}}&&{inside}]"


# Phrases (regular expression, label, weight) and thresholds of the style heuristic.
PHRASES = [
    (r"\bdelve(?:s|d)?\s+into\b", "delve into", 1.2),
    (r"\ba\s+testament\s+to\b", "a testament to", 1.1),
    (r"\brich\s+tapestry(?:\s+of)?\b", "rich tapestry", 1.3),
    (r"\bplays?\s+a\s+(?:pivotal|crucial|vital|key)\s+role\b", "plays a pivotal/crucial role", 1.0),
    (r"\bin\s+(?:today'?s|the)\s+(?:(?:fast-paced|ever-evolving|digital|rapidly\s+changing)\s+)*(?:world|landscape|era|environment)\b", "in today's fast-paced world/landscape", 1.4),
    (r"\bit\s+is\s+(?:important|essential|crucial|worth\s+noting)\s+to\s+(?:note|remember|consider|highlight)\b", "it is important/crucial to note", 0.9),
    (r"\bnot\s+only\b[\w\s,]+\bbut\s+(?:also\s+)?(?:serves\s+to|acts\s+as|highlights)\b", "not only ... but also serves to", 0.8),
    (r"\bserve(?:s|d)?\s+as\s+a\s+(?:beacon|reminder|catalyst|cornerstone)\b", "serves as a beacon/catalyst/cornerstone", 1.1),
    (r"\bunderscore(?:s|d)?\s+the\s+(?:importance|need|significance)\b", "underscores the importance/need", 0.9),
    (r"\bfoster(?:s|ing|ed)?\s+a\s+(?:sense|culture|deeper\s+understanding)\b", "fosters a sense/culture", 0.9),
    (r"\bseamlessly\s+(?:integrates?|integrated|blends?|combine[sd]?)\b", "seamlessly integrates/blends", 1.0),
    (r"\bnavigat(?:e|ing|es|ed)\s+the\s+(?:complexities|intricacies|nuances)\b", "navigating the complexities/nuances", 1.0),
    (r"\bmultifaceted\s+(?:nature|approach|landscape)\b", "multifaceted nature/approach", 1.0),
    (r"\bharness(?:ing|ed|es)?\s+the\s+power\s+of\b", "harnessing the power of", 1.0),
    (r"\ba\s+myriad\s+of\b", "a myriad of", 0.8),
    (r"\bparadigm\s+shift\b", "paradigm shift", 0.9),
    (r"\bholistic\s+(?:approach|view|perspective)\b", "holistic approach/perspective", 0.9),
    (r"\bin\s+conclusion\b[,\s]", "in conclusion", 0.8),
    (r"\bto\s+summarize\b[,\s]", "to summarize", 0.8),
    (r"\bultimately\b[,\s]", "ultimately,", 0.6),
    (r"\bfurthermore\b[,\s]", "furthermore,", 0.6),
    (r"\bmoreover\b[,\s]", "moreover,", 0.6),
    (r"\bas\s+an\s+ai\b", "as an AI", 1.5),
    (r"\bi\s+hope\s+this\s+helps\b", "I hope this helps", 1.2),
]
STYLE_THRESHOLD, MIN_WORDS, FULL_WORDS, MATTR_WINDOW = 0.65, 30, 100, 50
CONFIRMED = ["c2patool reports", "c2pa-related manifest", "png chunk c2", "png chunk cabx", "png chunk jumb", "png chunk jumd", "jpeg app11 segment", "digital_source_type", "digitalsourcetype", "trainedalgorithmicmedia", "compositewithtrainedalgorithmicmedia", "softwareagent"]
INFORMATIONAL = ["cms generator", "customxml parts", "xmp packet present", "unsupported", "not fully inspected", "format not", "svg <metadata> present", "not a valid", "truncated chunk", "bad segment length", "svg decode note"]
PROBABLE = ["ai:", "marker:", "meta:", "frontmatter", "json-ld", "attr:", "png ", "jpeg app", "exif", "xmp", "interesting", "pdf-structured", "layer-a"]

# Metadata hints and container names.
C2PA_MARKERS = ["c2pa", "C2PA", "jumb", "JUMB", "c2ma", "contentcredentials", "contentauth", "cai:", "http://ns.adobe.com/xmp/InstanceID/"]
AI_HINTS = ["c2pa", "C2PA", "contentcredentials", "ContentCredentials", "digitalSourceType", "trainedAlgorithmicMedia", "compositeWithTrainedAlgorithmicMedia", "algorithmicMedia", "AIGC", "aigc", "AI generated", "Generated by", "Claude", "Anthropic", "OpenAI", "SynthID", "dcterms:provenance"]
ALL_HINTS = AI_HINTS + C2PA_MARKERS
GENERATORS = ["ChatGPT", "DALL-E", "Midjourney", "Stable Diffusion", "SDXL", "FLUX", "DreamStudio", "Leonardo AI", "Leonardo.Ai", "Craiyon", "NovelAI", "Ideogram", "TensorArt", "Recraft", "Clipdrop", "DeepAI", "NightCafe", "Bing Image Creator", "Adobe Firefly", "Firefly", "Gemini", "Imagen", "Grok", "Sora", "Veo", "Kling", "Runway", "Luma", "Qwen", "GPT-4", "GPT-5"]
GENERATOR_KEYS = ["software", "creator", "parameters"]
STRONG = ["c2pa", "contentcredentials", "jumb", "contentauth"]
STRONG_CORE = ["c2pa", "contentcredentials", "jumb"]
AVIF_BRANDS = ["avif", "avis", "avio"]
HEIC_BRANDS = ["heic", "heix", "hevc", "heim", "heis", "mif1", "msf1", "heif"]
PNG_STRUCTURAL = ["IHDR", "IDAT", "IEND", "PLTE", "tRNS", "gAMA", "pHYs", "sRGB", "cHRM", "iCCP"]
WEBP_FLAGS = {"ICCP": 0x20, "EXIF": 0x08, "XMP ": 0x04}
XMP_UUID = bytes.fromhex("be7acfcb97a942e89c71999491e3afac")
GIF_XMP, GIF_CONTROL = "XMP DataXMP", ["NETSCAPE2.0", "ICCRGBG1012"]
TIFF_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
TIFF_NAMES = {269: "DocumentName", 270: "ImageDescription", 271: "Make", 272: "Model", 305: "Software", 306: "DateTime", 315: "Artist", 316: "HostComputer", 700: "XMP", 33432: "Copyright", 33723: "IPTC/NAA", 34377: "Photoshop", 34665: "ExifIFD", 34853: "GPSInfo", 37500: "MakerNote", 40091: "XPTitle", 40092: "XPComment", 40093: "XPAuthor", 40094: "XPKeywords", 40095: "XPSubject"}
TIFF_KEPT = frozenset([
    254, 255, 256, 257, 258, 259, 262, 263, 264, 265, 266, 273, 274, 277, 278, 279, 282, 283, 284, 285,
    286, 287, 288, 289, 290, 291, 292, 293, 294, 295, 296, 297, 301, 302, 304, 320, 321, 322, 323, 324,
    325, 326, 327, 328, 329, 330, 331, 332, 333, 334, 336, 338, 339, 340, 341, 342, 343, 344, 345, 346,
    347, 512, 513, 514, 515, 517, 518, 519, 520, 521, 529, 530, 531, 532, 33421, 33422, 33423, 50706, 50707, 50708,
    50709, 50710, 50711, 50712, 50713, 50714, 50715, 50716, 50717, 50718, 50719, 50720, 50721, 50722, 50723, 50724, 50725, 50726, 50727, 50728,
    50729, 50730, 50731, 50732, 50733, 50734, 50735, 50736, 50737, 50738, 50739, 50740, 50741,
])
TIFF_SUB_IFDS = (34665, 34853, 40965)
INFLATE_CAP, IFD_CAP = 16 << 20, 4096
LOCAL_LIMIT, SERVER_LIMIT = 64 << 20, 256 << 20
TEXT_EXTENSIONS = ["txt", "md", "markdown", "html", "htm", "svg"]
IMAGE_EXTENSIONS = ["png", "jpg", "jpeg", "webp", "avif", "heic", "heif", "bmp", "gif", "tif", "tiff"]
SERVER_EXTENSIONS = ["pdf", "docx", "odt", "epub"]
# Buckets of findings (Java regex) and lines that are structure only.
BUCKETS = {
    "c2pa": r"(?i)c2pa|jumb|content ?credentials|contentauth|cai:|manifest",
    "xmp": r"(?i)\bxmp\b|xml metadata|xpacket|adobe:ns:meta",
    "exif": r"(?i)\bexif\b|\bAPP1\b(?![\s\S]*xmp)|TIFF (tag|IFD)|\bIFD\b",
    "ai-generator-marker": r"(?i)AI generator|Software=|Creator=|parameters=|digitalSourceType|trainedAlgorithmicMedia|dall-e|midjourney|stable diffusion|chatgpt|gemini|firefly|sora|flux|sdxl",
}
STRUCTURAL = r"(?i)truncated|bad segment|mismatch|trailing|no .*metadata|unrecognized|header-only"

# Decision bounds of the model-bound detectors.
KGW_Z_DETECTED, KGW_Z_CLEAN, KGW_MIN_TOKENS, KGW_GAMMA = 4.0, 2.0, 50, 0.25
SYNTHID_CLEAN_BELOW, SYNTHID_MIN_TOKENS = 0.12, 100
GUMBEL_WINDOW, GUMBEL_THRESHOLD = 4, 1e-6

#: Detectors in order: id, layer, local, requires_key, requires_model, heuristic.
DETECTORS = [
    ("unicode-invisible", "character", True, False, False, False), ("bidi-controls", "character", True, False, False, False), ("homoglyph", "character", True, False, False, False),
    ("c2pa", "metadata", True, False, False, False), ("xmp", "metadata", True, False, False, False), ("exif", "metadata", True, False, False, False),
    ("ai-generator-marker", "metadata", True, False, False, False), ("other-metadata", "metadata", True, False, False, False),
    ("stylometry", "statistical", True, False, False, True), ("gumbel", "statistical", True, True, False, False), ("kgw", "statistical", True, True, True, False),
    ("synthid-text", "statistical", True, True, True, False), ("upstream-detect", "statistical", False, True, True, False), ("textseal", "statistical", True, True, True, False),
]
STATUSES = ("detected", "clean", "uncertain", "not_tested", "unavailable", "not_applicable", "error")
