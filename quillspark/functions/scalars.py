"""Scalar functions of the assessment domain as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Difficulty codes in teaching order (recognise, understand, apply, apply well).
DIFFICULTIES = ("NB", "TH", "VD", "VDC")
# Total experience from which each level starts.
LEVEL_STARTS = (0, 100, 250, 500, 900, 1400, 2100, 3000, 4200, 5700, 7500)
# Quiz difficulty names and bank codes.
QUIZ_TO_BANK = {"easy": "NB", "medium": "TH", "hard": "VD", "expert": "VDC"}
# Roman chapter numbers.
ROMAN = ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX", "X", "XI", "XII")
# Words that count as true.
TRUE_WORDS = ("true", "1", "yes", "đúng")
# Ways to write that a statement is not given.
NOT_GIVEN = ("not given", "notgiven", "ng", "not_given")


def normalised(x: Column) -> Column:
    """Lower-cased, trimmed text with runs of white space collapsed (Unicode white space too)."""
    return F.lower(F.trim(F.regexp_replace(F.coalesce(x, F.lit("")), "(?U)\\s+", " ")))


def content_hash(x: Column) -> Column:
    """MD5 of the normalised text."""
    return F.md5(normalised(x))


def code_key(x: Column) -> Column:
    """Comparison key of an answer: trimmed, upper case."""
    return F.upper(F.trim(x))


def after_first_dot(x: Column) -> Column:
    """What follows the first dot; the whole text without one."""
    return F.regexp_replace(x, "^[^.]*\\.", "")


def safe_filename(x: Column, default: str = "export", most: int = 60) -> Column:
    """ASCII letters, digits, dash and underscore; other runs become one underscore."""
    folded = F.translate(fold(x), "đĐ", "dD")
    made = F.substring(F.regexp_replace(F.regexp_replace(folded, "[^A-Za-z0-9_-]+", "_"), "^_+|_+$", ""), 1, most)
    return F.when(F.coalesce(made, F.lit("")) == "", default).otherwise(made)


_BASES = {"a": "àáâãäåāăąạảấầẩẫậắằẳẵặ", "e": "èéêëēĕėęěẹẻẽếềểễệ", "i": "ìíîïĩīĭįỉị", "o": "òóôõöōŏőơọỏốồổỗộớờởỡợ", "u": "ùúûüũūŭůűųưụủứừửữự", "y": "ýÿỳỵỷỹ", "c": "çćĉċč", "n": "ñńņň", "s": "śŝşš", "z": "źżž"}


def fold(x: Column) -> Column:
    """Letters without their accents; đ stays a letter of its own."""
    marked = "".join(_BASES.values())
    plain = "".join(base * len(v) for base, v in _BASES.items())
    return F.translate(x, marked + marked.upper(), plain + plain.upper())


def clean_text(x: Column) -> Column:
    """Extracted text: control characters out, long blank runs cut, tabs to one blank, Icelandic eth to the Vietnamese letter."""
    x = F.regexp_replace(x, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]", "")
    x = F.regexp_replace(F.regexp_replace(x, "\\n{4,}", "\n\n\n"), " {3,}", "  ")
    return F.translate(F.trim(F.regexp_replace(x, "\\t+", " ")), "Ð", "Đ")


def model_text(x: Column) -> Column:
    """The variant for prompts: control characters stay, every tab is one blank."""
    x = F.regexp_replace(F.regexp_replace(x, "\\n{4,}", "\n\n\n"), " {3,}", "  ")
    return F.translate(F.trim(F.replace(x, F.lit("\t"), F.lit(" "))), "Ð", "Đ")


def xml_safe(x: Column) -> Column:
    """Without the control characters that XML forbids."""
    return F.regexp_replace(x, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", "")


def html_escaped(x: Column) -> Column:
    """Escaped for HTML, line ends as breaks."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "<br>")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def latex_escaped(x: Column) -> Column:
    """Escaped for LaTeX, but for what stands between dollar signs."""
    parts = F.split(x, "\\$", -1)

    def outside(s: Column) -> Column:
        s = F.regexp_replace(s, "([&%#_{}])", "\\\\$1")
        return F.replace(F.replace(s, F.lit("~"), F.lit("\\textasciitilde{}")), F.lit("^"), F.lit("\\textasciicircum{}"))

    return F.array_join(F.transform(parts, lambda s, i: F.when(i % 2 == 0, outside(s)).otherwise(s)), "$")


def escapes_repaired(x: Column) -> Column:
    """Control characters that swallowed a backslash become the two characters again."""
    for a, b in (("\f", "\\f"), ("\b", "\\b"), ("\r", "\\r"), ("\t", "\\t"), ("\a", "\\a"), ("\v", "\\v")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def math_segments(x: Column) -> Column:
    """Alternating (is_math, text) segments of a text with dollar signs; empty ones are left out."""
    parts = F.transform(F.split(x, "\\$", -1), lambda s, i: F.struct((i % 2 == 1).alias("is_math"), s.alias("text")))
    return F.filter(parts, lambda s: s["text"] != "")


def half_even(x: Column, n: int = 0) -> Column:
    return F.bround(x, n)


def null_if_zero(x: Column) -> Column:
    """A mean of zero is shown as missing."""
    return F.when(x != 0, x)


def percent(a: Column, b: Column, n: int = 1) -> Column:
    """a / b in percent, null where b is 0."""
    return F.bround(F.try_divide(a * F.lit(100.0), b), n)


def growth(new: Column, last: Column) -> Column:
    """Change in percent; 100 from nothing to something, 0 from nothing to nothing."""
    return F.when(last > 0, F.bround((new - last) / last * 100)).when(new > 0, 100.0).otherwise(0.0)


def to_bool(x: Column) -> Column:
    """Words for true, and numbers other than zero; null stays null."""
    s = F.lower(F.trim(x))
    number = F.when(s.rlike("^[-+]?\\d+(\\.\\d+)?$"), s).try_cast("double")
    return F.when(x.isNull(), F.lit(None)).otherwise(s.isin(*TRUE_WORDS) | (F.coalesce(number, F.lit(0.0)) != 0))


def not_given_key(x: Column) -> Column:
    s = F.lower(F.trim(x))
    return F.when(s.isin(*NOT_GIVEN), "not given").when(s.isin("t", "true"), "true").when(s.isin("f", "false"), "false").when(s.isin("y", "yes"), "yes").when(s.isin("n", "no"), "no").otherwise(s)


def roman(x: Column) -> Column:
    """I to XII as numbers, else null."""
    at = F.array_position(F.array(*map(F.lit, ROMAN)), F.upper(F.trim(x)))
    return F.when(at > 0, at.cast("int"))


def level(total: Column) -> Column:
    """Level reached with a total of experience points."""
    out = F.lit(1)
    for k, start in enumerate(LEVEL_STARTS[1:], 2):
        out = F.when(total >= start, k).otherwise(out)
    return out


def difficulty_rank(x: Column) -> Column:
    """1 to 4 in teaching order, 5 for everything else."""
    out = F.lit(len(DIFFICULTIES) + 1)
    for k, d in reversed(list(enumerate(DIFFICULTIES, 1))):
        out = F.when(x == d, k).otherwise(out)
    return out


def join_code(seed: Column, length: int = 6) -> Column:
    """A code of letters and digits drawn from a hash of the seed."""
    h = F.sha2(seed.cast("string"), 256)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    picks = [F.substring(F.lit(alphabet), (F.conv(F.substring(h, 1 + 4 * k, 4), 16, 10).cast("int") % 36) + 1, F.lit(1)) for k in range(length)]
    return F.concat(*picks)


def display_name(name: Column, email: Column) -> Column:
    return F.coalesce(F.nullif(name, F.lit("")), email)


def local_part(email: Column) -> Column:
    return F.split_part(email, F.lit("@"), F.lit(1))


def client_address(forwarded: Column, peer: Column, trusted: Column) -> Column:
    """First hop of the forwarded header if the proxy is trusted, else the peer."""
    hop = F.trim(F.split_part(forwarded, F.lit(","), F.lit(1)))
    return F.when(trusted & (F.coalesce(hop, F.lit("")) != ""), hop).otherwise(peer)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; a zero vector has similarity 0."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def fitted(vector: Column, dims: int) -> Column:
    """Cut or padded with zeros to ``dims`` numbers."""
    short = F.greatest(F.lit(dims) - F.size(vector), F.lit(0))
    return F.slice(F.concat(vector, F.array_repeat(F.lit(0.0).cast("float"), short)), 1, dims)


# Content types and file extensions of uploaded media.
CONTENT_TYPES = {
    "audio/mpeg": ".mp3", "audio/mp3": ".mp3", "audio/wav": ".wav", "audio/x-wav": ".wav", "audio/ogg": ".ogg", "audio/mp4": ".m4a", "audio/x-m4a": ".m4a", "audio/aac": ".aac",
    "image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp",
}


def extension_of(content_type: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv]), F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))), F.lit(".bin"))


def direct_link(url: Column) -> Column:
    """Share links of file hosts as links to the file itself."""
    drive = F.regexp_extract(url, "drive\\.google\\.com/file/d/([^/?]+)", 1)
    box = F.regexp_replace(url, "([?&])dl=0", "$1dl=1")
    return F.when(drive != "", F.concat(F.lit("https://drive.google.com/uc?export=download&id="), drive)).when(url.contains("dropbox.com"), box).otherwise(url)


def escaped_like(x: Column) -> Column:
    """A pattern that matches the text itself."""
    return F.regexp_replace(x, "([\\\\%_])", "\\\\$1")


def slug_ok(x: Column) -> Column:
    return x.rlike("^[a-z0-9][a-z0-9-]{1,97}[a-z0-9]$")
