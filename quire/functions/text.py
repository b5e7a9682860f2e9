"""Text encodings and folding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quire.functions import col, let

EDGE_SPACE = r"^[\s\u0085\p{Z}]+|[\s\u0085\p{Z}]+$"
# Characters with the Unicode White_Space property.
WHITE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
INNER_SPACE = r"[\s\u00A0\uFEFF\p{Z}]+"
INK = r"[^\s\u0085\p{Z}]"

# Letters the label font shows beyond ASCII and Latin-1.
SHOWN = "İıŞşĞğ€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"

# Nearest ASCII letter of other Latin letters.
NEAREST = {
    "A": "ĀĂĄ",
    "a": "āăą",
    "C": "ĆĈĊČ",
    "c": "ćĉċč",
    "D": "ĎĐ",
    "d": "ďđ",
    "E": "ĒĔĖĘĚ",
    "e": "ēĕėęě",
    "G": "ĜĠĢ",
    "g": "ĝġģ",
    "H": "ĤĦ",
    "h": "ĥħ",
    "I": "ĨĪĬĮ",
    "i": "ĩīĭį",
    "K": "Ķ",
    "k": "ķ",
    "L": "ĹĻĽĿŁ",
    "l": "ĺļľŀł",
    "N": "ŃŅŇ",
    "n": "ńņň",
    "O": "ŌŎŐ",
    "o": "ōŏő",
    "R": "ŔŖŘ",
    "r": "ŕŗř",
    "S": "ŚŜ",
    "s": "śŝ",
    "T": "ŢŤŦ",
    "t": "ţťŧ",
    "U": "ŨŪŬŮŰŲ",
    "u": "ũūŭůűų",
    "W": "Ŵ",
    "w": "ŵ",
    "Y": "Ŷ",
    "y": "ŷ",
    "Z": "ŹŻ",
    "z": "źż",
}
FOLD_FROM = "".join(NEAREST.values())
FOLD_TO = "".join(ascii_ * len(letters) for ascii_, letters in NEAREST.items())

# Single-byte codes of PDF text strings that differ from Latin-1.
PDF_LOW = "˘ˇˆ˙˝˛˚˜"  # 0x18..0x1F
PDF_HIGH = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"  # 0x80..0x9E
PDF_EURO = "€"  # 0xA0
PDF_FROM = (
    "".join(map(chr, range(0x18, 0x20))) + "".join(map(chr, range(0x80, 0x9F))) + "\u00a0"
    # codes without a character disappear
    + "\u007f\u009f\u00ad"
)
PDF_TO = PDF_LOW + PDF_HIGH + PDF_EURO


def is_blank(text: Column | str) -> Column:
    """Nothing but white space."""
    return ~col(text).rlike(INK)


def fold_text(text: Column | str) -> Column:
    """Letters the label font lacks become ASCII; what has no match becomes "?"."""
    plain = col(text)
    letters = F.translate(plain, FOLD_FROM, FOLD_TO)
    letters = F.replace(F.replace(letters, F.lit("Ĳ"), F.lit("IJ")), F.lit("ĳ"), F.lit("ij"))
    # most texts have none of these letters, and looking is cheaper than translating
    folded = F.when(plain.rlike("[\u0100-\u017F]"), letters).otherwise(plain)
    # the wide class rejects nearly every character before the long one is asked
    return F.regexp_replace(folded, rf"[^\x20-\x7E\u00A0-\u00FF](?<![{SHOWN}])", "?")


def decode_meta(raw: Column | str) -> Column:
    """Metadata bytes to text: UTF-16BE after FE FF, else the PDF single-byte code."""

    def build(b: Column) -> Column:
        wide = F.hex(F.substring(b, 1, 2)) == "FEFF"
        text = F.when(wide, F.decode(b, "UTF-16")).otherwise(
            F.translate(F.decode(b, "ISO-8859-1"), PDF_FROM, PDF_TO)
        )
        return F.regexp_replace(text, EDGE_SPACE, "")

    return let(col(raw).cast("binary"), build)


def encode_meta(text: Column | str) -> Column:
    """ASCII as it is, anything else as FE FF and UTF-16BE."""

    def build(t: Column) -> Column:
        return F.when(~t.rlike(r"[^\x00-\x7F]"), F.encode(t, "US-ASCII")).otherwise(
            F.concat(F.unhex(F.lit("FEFF")), F.encode(t, "UTF-16BE"))
        )

    return let(col(text), build)
