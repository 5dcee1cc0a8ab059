"""Column functions over text: direction, script, signatures, list markers, labels, escaping."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges of the strong characters that are counted for each script.
SCRIPT_RANGES = {
    "arabic": r"\x{0600}-\x{06FF}\x{0750}-\x{077F}\x{08A0}-\x{08FF}\x{FB50}-\x{FDFF}\x{FE70}-\x{FEFF}",
    "hebrew": r"\x{0590}-\x{05FF}\x{FB1D}-\x{FB4F}",
    "cjk": r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}",
    "cyrillic": r"\x{0400}-\x{052F}",
    "greek": r"\x{0370}-\x{03FF}\x{1F00}-\x{1FFF}",
    "latin": r"A-Za-z\x{00C0}-\x{024F}",
}
RTL = ("arabic", "hebrew")
KANA = r"\x{3040}-\x{30FF}"
# The named character references that are decoded, and what stands for them.
ENTITIES = {
    "amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": "\u00a0", "copy": "©", "reg": "®", "trade": "™", "mdash": "—", "ndash": "–",
    "hellip": "…", "laquo": "«", "raquo": "»", "eacute": "é", "egrave": "è", "agrave": "à", "ccedil": "ç", "rsquo": "\u2019", "lsquo": "\u2018", "ldquo": "\u201c", "rdquo": "\u201d",
}
#: A reference that is decoded, or a stretch without one.
REFERENCE = "&(?:#[0-9]{1,9}|#[xX][0-9A-Fa-f]{1,7}|" + "|".join(ENTITIES) + ");|[^&]+|&"
# Marks of list items. Glyphs of the first kind need no space after them.
GLYPHS, DASHES = "•‣◦▪·", "*–—-"
ORDINAL = "(?:[0-9]+|[A-Za-z]|[ivxlcdm]{2,}|[IVXLCDM]{2,})[.)]"
# Words that a caption begins with.
CAPTION_CUES = ("figure", "fig.", "table", "tableau", "image", "illustration")


def count_of(text: Column, ranges: str) -> Column:
    """How many characters of text lie in the ranges."""
    return F.length(F.regexp_replace(text, f"[^{ranges}]+", ""))


def _ascii_apart(text: Column) -> tuple[Column, Column]:
    """How many ASCII letters a text holds, and its other characters beyond ASCII, in which alone the scripts are looked for."""
    strong = F.regexp_replace(text, r"[\x00-@\[-`{-\x7F]+", "")
    other = F.regexp_replace(strong, "[A-Za-z]+", "")
    return F.length(strong) - F.length(other), other


def script_tallies(text: Column) -> dict[str, Column]:
    letters, other = _ascii_apart(text)
    return {name: count_of(other, ranges) + (letters if name == "latin" else 0) for name, ranges in SCRIPT_RANGES.items()}


def _most(*choices: tuple[Column, str]) -> Column:
    """The name of the greatest count, the first of equals; each count stands in the expression once, so it is taken once."""
    return F.greatest(*[F.struct(n.alias("n"), F.lit(-i).alias("i"), F.lit(name).alias("name")) for i, (n, name) in enumerate(choices)])["name"]


def dominant_script(tallies: dict[str, Column]) -> Column:
    """The script counted most; the order of SCRIPT_RANGES breaks ties; "other" if nothing was counted."""
    return _most((F.lit(0), "other"), *[(n, name) for name, n in tallies.items()])


def script(text: Column) -> Column:
    """The dominant script of a text; its letters are counted only where some are of another script than Latin."""
    other = F.regexp_replace(text, r"[\x00-\x7F]+", "")
    foreign = count_of(other, "".join(r for s, r in SCRIPT_RANGES.items() if s != "latin"))
    return F.when(foreign > 0, dominant_script(script_tallies(text))).when(text.rlike(f"[{SCRIPT_RANGES['latin']}]"), "latin").otherwise("other")


def direction(text: Column) -> Column:
    """rtl if strictly more strong characters run right to left; neutral if there are none; else ltr.

    They are counted only where some run right to left.
    """
    to_left = "".join(SCRIPT_RANGES[s] for s in RTL)
    to_right = "".join(r for s, r in SCRIPT_RANGES.items() if s not in RTL)
    found = count_of(F.regexp_replace(text, r"[\x00-\x7F]+", ""), to_left)
    letters, other = _ascii_apart(text)
    counted = _most((count_of(other, to_right) + letters, "ltr"), (count_of(other, to_left), "rtl"))
    return F.when(found > 0, counted).when(~text.rlike(f"[{to_right}]"), "neutral").otherwise("ltr")


def language_guess(script: Column, text: Column) -> Column:
    return F.when(script == "arabic", "ar").when(script == "hebrew", "he").when((script == "cjk") & (count_of(text, KANA) > 0), "ja").when(script == "cjk", "zh")


def collapse_whitespace(text: Column) -> Column:
    return F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " ")


def signature(text: Column) -> Column:
    """What is compared to find running furniture: lower case, single spaces, and, in lines of at most six
    letters, runs of one to four digits as #."""
    plain = F.trim(collapse_whitespace(F.lower(text)))
    letters = F.length(F.regexp_replace(plain, r"[^\p{L}]", ""))
    return F.when(letters <= 6, F.regexp_replace(plain, r"(?<![0-9])[0-9]{1,4}(?![0-9])", "#")).otherwise(plain)


def list_marker(text: Column) -> Column:
    """bullet, decimal, roman, letter or none, for the marker that a line begins with.

    A lone letter is a letter, i, v and x too; a Roman numeral has two digits or more.
    """
    t = F.regexp_replace(text, r"^\s+", "")
    return (
        F.when(t.rlike(rf"^(?:[{GLYPHS}]|[{DASHES}]\s)"), "bullet")
        .when(t.rlike(r"^[0-9]+[.)](?:\s|$)"), "decimal")
        .when(t.rlike(r"^[A-Za-z][.)](?:\s|$)"), "letter")
        .when(t.rlike(r"^(?:[ivxlcdm]{2,}|[IVXLCDM]{2,})[.)](?:\s|$)"), "roman")
        .otherwise("none")
    )


def strip_marker(text: Column) -> Column:
    """A line without its leading white space, its marker and the white space after it."""
    return F.regexp_replace(F.regexp_replace(text, r"^\s+", ""), rf"^(?:[{GLYPHS}]\s*|[{DASHES}]\s+|{ORDINAL}(?:\s+|$))", "")


def roman_value(label: Column) -> Column:
    """The number of a Roman numeral of either case: a digit before a larger one is taken away; null for anything else."""
    one = F.create_map(*[F.lit(x) for pair in zip("ivxlcdm", (1, 5, 10, 50, 100, 500, 1000)) for x in pair])
    digits = F.transform(F.split(F.lower(label), ""), lambda c: F.element_at(one, c))
    after = F.concat(F.slice(digits, F.lit(2), F.size(digits)), F.array(F.lit(0)))
    total = F.aggregate(F.zip_with(digits, after, lambda x, y: F.when(x < y, -x).otherwise(x)), F.lit(0), lambda a, x: a + x)
    return F.when(label.rlike("^(?:[ivxlcdm]+|[IVXLCDM]+)$") & (total > 0), total)


def ordinal(text: Column) -> Column:
    """The number of an ordered list marker: digits, a letter's place, a Roman numeral; null without one."""
    kind, label = list_marker(text), F.regexp_extract(text, r"^\s*([0-9A-Za-z]+)[.)]", 1)
    return F.when(kind == "decimal", F.expr("try_cast(1 as bigint)") * label.try_cast("bigint")).when(kind == "letter", F.ascii(F.lower(label)) - 96).when(kind == "roman", roman_value(label))


def is_caption(text: Column) -> Column:
    """Whether a text opens with a caption's cue that no letter follows."""
    cues = "|".join(c.replace(".", "[.]") for c in CAPTION_CUES)
    return F.lower(text).rlike(rf"^\s*(?:{cues})(?:[^a-z]|$)")


def capitalized(text: Column) -> Column:
    """The first letter of each word in upper case, the others as they are."""
    words = F.regexp_extract_all(text, F.lit(r"\s+|\S+"), F.lit(0))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, F.lit(1), F.lit(1))), F.substring(w, F.lit(2), F.length(w)))), "")


def page_label(style: Column, prefix: Column, number: Column) -> Column:
    """A page label: a prefix and the number as D, R, r, A or a says; no style, no number."""
    plain = F.when(style == "D", number.cast("string")).when(style == "R", roman(number)).when(style == "r", F.lower(roman(number)))
    shown = plain.when(style == "A", F.upper(repeated_letters(number))).when(style == "a", repeated_letters(number))
    return F.concat(prefix, F.coalesce(shown, F.lit("")))


def color_hex(red: Column, green: Column, blue: Column) -> Column:
    """#rrggbb of three parts from 0 to 1, clamped."""
    part = lambda c: F.lpad(F.lower(F.hex(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), c)) * 255 + 0.5).cast("int"))), 2, "0")
    return F.concat(F.lit("#"), part(red), part(green), part(blue))


def hex_color(text: Column) -> Column:
    """The parts, 0 to 255, of #rgb or #rrggbb; null for anything else."""
    t = F.lower(F.trim(text))
    wide = F.when(t.rlike("^#[0-9a-f]{6}$"), t).when(t.rlike("^#[0-9a-f]{3}$"), F.regexp_replace(t, "([0-9a-f])", "$1$1"))
    return F.when(wide.isNotNull(), F.array(*[F.conv(F.substring(wide, k, 2), 16, 10).cast("int") for k in (2, 4, 6)]))


def roman(n: Column) -> Column:
    """1 to 3999 as a Roman numeral, else in decimal digits."""
    out = []
    for place, (one, five, ten) in ((1000, "M  "), (100, "CDM"), (10, "XLC"), (1, "IVX")):
        digit = F.floor(n / place) % 10
        forms = ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
        out.append(F.element_at(F.array(*map(F.lit, forms)), (digit + 1).cast("int")))
    return F.when(n.between(1, 3999), F.concat(*out)).otherwise(n.cast("string"))


def letters(n: Column, width: int = 4) -> Column:
    """Bijective base 26 (1 is a, 26 is z, 27 is aa), for up to `width` letters."""
    parts, rest = [], n
    for _ in range(width):
        parts.append(F.when(rest > 0, F.char(F.lit(97) + (rest - 1) % 26)).otherwise(""))
        rest = F.floor((rest - 1) / 26)
    return F.concat(*reversed(parts))


def repeated_letters(n: Column) -> Column:
    """The page label scheme: a to z, then aa to zz, and so on; null below 1."""
    return F.when(n > 0, F.repeat(F.char(F.lit(97) + (n - 1) % 26), (F.floor((n - 1) / 26) + 1).cast("int")))


def repeated_letters_md5(n: Column) -> Column:
    """The MD5 of repeated_letters(n), without the labels: a running hash of each letter is carried from one length to the next.

    A worker keeps the hashes of some lengths, so all labels together cost about as many bytes as the greatest n, and a
    label that comes out of order no more than STRIDE bytes besides.
    """

    @F.pandas_udf("string")
    def digests(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        runs = [RunningHashes(chr(97 + i).encode()) for i in range(26)]
        for numbers in batches:
            out = {n: runs[(n - 1) % 26].digest((n - 1) // 26 + 1) for n in sorted(set(numbers.dropna().astype("int64"))) if n > 0}
            yield numbers.astype("Int64").map(out, na_action="ignore").astype(object)

    return digests(F.when(n <= 26 * (2**31 - 1), n.cast("bigint")))  # a longer label is no string


class RunningHashes:
    """MD5 of one byte repeated, for any number of lengths: each goes on from the longest kept hash that is not longer."""

    STRIDE, KEEP = 4096, 1024  # a hash is kept each so many bytes; twice as far apart whenever there are more than so many

    def __init__(self, byte: bytes):
        self.block, self.stride, self.kept = byte * self.STRIDE, self.STRIDE, [hashlib.md5(usedforsecurity=False)]
        self.last, self.length = self.kept[0].copy(), 0

    def digest(self, length: int) -> str:
        at = min(length // self.stride, len(self.kept) - 1)
        if not at * self.stride <= self.length <= length:
            self.last, self.length = self.kept[at].copy(), at * self.stride
        while self.length < length:
            step = min(length, (self.length // self.STRIDE + 1) * self.STRIDE) - self.length
            self.last.update(self.block[:step])
            self.length += step
            if self.length == len(self.kept) * self.stride:
                self.kept.append(self.last.copy())
                if len(self.kept) > self.KEEP:
                    self.kept, self.stride = self.kept[::2], self.stride * 2
        return self.last.hexdigest()


def escape_html(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]<>|#])", r"\\$1")


def decode_entities(text: Column) -> Column:
    """Named and numeric character references decoded, once; others stay as they are."""
    names = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])

    def one(piece: Column) -> Column:
        name = F.substring(piece, F.lit(2), F.length(piece) - 2)
        hexed = F.lower(F.substring(name, 1, 2)) == "#x"
        digits = F.substring(name, F.when(hexed, 3).otherwise(2), F.length(name))
        code = F.when(hexed, F.conv(digits, 16, 10)).otherwise(digits).try_cast("bigint")
        exists = (code < 0x110000) & ~code.between(0xD800, 0xDFFF)
        char = F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")
        numeric = F.when(exists, char).otherwise(piece)
        return F.when(~piece.rlike("^&.+;$"), piece).when(F.startswith(name, F.lit("#")), numeric).otherwise(F.element_at(names, name))

    pieces = F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0))
    return F.when(F.contains(text, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(text)


def csv_field(text: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line end."""
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[,"\r\n]'), quoted).otherwise(text)


def tidy_markdown(text: Column) -> Column:
    """At most one blank line in a row, and one line end at the end."""
    return F.concat(F.regexp_replace(F.regexp_replace(text, "\n{3,}", "\n\n"), r"\n+$", ""), F.lit("\n"))


def longest_backticks(text: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(F.regexp_extract_all(text, F.lit("`+"), F.lit(0)), F.length)), F.lit(0))


def escape_json(text: Column) -> Column:
    """A JSON string with its quotes: \\n, \\r and \\t by name, other control characters by number."""
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    rare = text
    for code in set(range(32)) - {9, 10, 13}:
        rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.concat(F.lit('"'), F.when(text.rlike(r"[\x00-\x1F]"), rare).otherwise(text), F.lit('"'))


def yaml_scalar(text: Column) -> Column:
    """As it is, or quoted where YAML would read it otherwise: empty, spaces at an end, an indicator in front, ": ", " #", line ends, tabs."""
    quoted = text
    for plain, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t")):
        quoted = F.replace(quoted, F.lit(plain), F.lit(escaped))
    return F.when(text.rlike(r"""^$|^ | $|^[!&*?|>%@`"'#-]|: | #|[\n\t]"""), F.concat(F.lit('"'), quoted, F.lit('"'))).otherwise(text)


def link_destination(url: Column) -> Column:
    """A Markdown link's destination: in angle brackets if it has a space or a control character, else with parentheses escaped."""
    angled = F.concat(F.lit("<"), F.replace(F.replace(url, F.lit("<"), F.lit("%3C")), F.lit(">"), F.lit("%3E")), F.lit(">"))
    return F.when(url.rlike(r"[ \x00-\x1F\x7F\x{80}-\x{9F}]"), angled).otherwise(F.replace(F.replace(url, F.lit("("), F.lit("%28")), F.lit(")"), F.lit("%29")))


def hmac_sha256(key: bytes, message: Column) -> Column:
    """The hexadecimal HMAC of a text in UTF-8 under a key."""
    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in key)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
