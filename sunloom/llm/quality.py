"""Quality rules, line first: bad lines go, then documents that lose too much of their text.

Lines are judged by three rules. Punctuation: a line fails whose marks (all but letters,
digits, combining signs and white space) outnumber ``MARKS_A_WORD`` a word, or which
neither ends with a mark of punctuation nor holds a sentence end. Navigation: a line
fails that holds three or more separators of menus, or that has at most three words and
begins with one of menus. Boilerplate: a line fails that speaks of licences, copyright,
cookies and the like. Only built-in functions are used, within each row; nothing is
shuffled. A line that holds none of the signs of separators or of boilerplate, as most, is
not searched for their patterns.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sunloom.llm.words import SPACE, aside

MARKS_A_WORD = 0.8
#: share of the words' characters that a document may lose with its lines
MAY_LOSE = 0.6
SYMBOLS = "#*$%&|<>"
WINDOW = 5

MARK = r"[^\p{L}\p{M}\p{N}\s]"
SENTENCE = r"[.!?…。！？][\"'”’»)\]]*(\s|$)|[:;,\"'”’»)]\s*$"
SEPARATORS = r"(\||›|»|::|>>|•|/ ).*(\||›|»|::|>>|•|/ ).*(\||›|»|::|>>|•|/ )"
MENU = r"(?i)^\s*(home|menu|login|log in|sign in|sign up|search|contact|about|next|previous|share|subscribe)\b"
BOILERPLATE = (
    r"(?i)\blicen[sc]ed? under\b|\bgeneral public license\b|\breleased under the\b|\ball rights reserved\b|\bcopyright\b|©|"
    r"\bcookie|\bprivacy policy\b|\bterms of (use|service)\b|\benable javascript\b|\bpowered by\b|\blorem ipsum\b"
)
#: a line that SEPARATORS finds holds one of these
SEPARATOR_SIGNS = ("|", "›", "»", "::", ">>", "•", "/ ")
#: a line that BOILERPLATE finds holds one of these in lower case
BOILERPLATE_SIGNS = (
    "licen", "released under the", "all rights reserved", "copyright", "©",
    "cookie", "privacy policy", "terms of ", "enable javascript", "powered by", "lorem ipsum",
)


def solid(text: Column) -> Column:
    """The text without the white space that separates words."""
    for c in " \n\t\r\x0b\x0c":
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def holds(text: Column, signs: tuple[str, ...]) -> Column:
    return reduce(or_, (F.contains(text, F.lit(s)) for s in signs))


def repeat_words(words: str, width: int = WINDOW) -> list[tuple[str, Column]]:
    """Steps that count the words inside windows found twice or more in one row.

    Windows are compared by 64-bit hashes. Each word is hashed once; the hash of a window is
    made of those of two shorter ones, at its start and at its end. Only rows with a repeated
    window sort theirs. Each step is a column of its own, since the next uses it more than once.
    """
    steps, n = [("_h1", F.transform(words, lambda w: F.xxhash64(w)))], 1
    while n < width:
        h, shift = f"_h{n}", min(n, width - n)
        n += shift
        starts = F.slice(h, 1, F.greatest(F.size(h) - shift, F.lit(0)))
        steps.append((f"_h{n}", F.zip_with(starts, F.slice(h, shift + 1, F.size(h)), lambda a, b: F.xxhash64(a, b))))
    h = f"_h{n}"
    placed = F.when(F.size(F.array_distinct(h)) < F.size(h), F.sort_array(F.transform(h, lambda h, i: F.struct(h.alias("h"), i.alias("i")))))
    twice = F.filter("_p", lambda x, i: (x["h"] == F.get(F.col("_p"), i - 1)["h"]) | (x["h"] == F.get(F.col("_p"), i + 1)["h"]))
    at = F.sort_array(F.transform(twice, lambda x: x["i"]))
    own = F.transform("_at", lambda p, i: F.least(F.lit(width), F.coalesce(F.get(F.col("_at"), i + 1) - p, F.lit(width))))
    total = F.coalesce(F.aggregate(own, F.lit(0).cast("long"), lambda s, x: s + x), F.lit(0)).cast("long")
    return [*steps, ("_p", placed), ("_at", at), ("n_repeat_words", total)]


def bad_line(line: Column) -> Column:
    words = F.length(line) - F.length(F.replace(line, F.lit(" "), F.lit(""))) + 1
    marks = F.length(line) - F.length(F.regexp_replace(line, MARK, ""))
    punctuation = ~line.rlike(SENTENCE) | (marks > F.lit(MARKS_A_WORD) * words)
    navigation = (line.rlike(MENU) & (words <= 3)) | (holds(line, SEPARATOR_SIGNS) & line.rlike(SEPARATORS))
    speaks = F.exists(F.array(F.lower(line)), lambda low: holds(low, BOILERPLATE_SIGNS))  # lower once for all signs
    return punctuation | navigation | (speaks & line.rlike(BOILERPLATE))


JUDGED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "lost_chars", "base_failed", "kept", "clean_text")


def judge(docs: DataFrame, may_lose: float = MAY_LOSE) -> DataFrame:
    """All columns with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_chars,
    base_failed, kept and ``clean_text`` (the good lines).

    A null text has no words and fails the base; its clean text is empty. Lines without a
    word count for nothing and are not part of the clean text. Each row stands alone, so
    ties and repeated rows need no rule; a very long text is one row's work. Input columns
    named like an added one are left out, all others come back; an empty table gives no rows.
    """
    docs, named = aside(docs, ["text"], JUDGED)
    df = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    df = df.withColumn("_w", F.array_remove(F.split("_t", f"[{SPACE}]+"), ""))
    df = df.withColumn("_l", F.filter(F.split("_t", "\n"), lambda x: x.rlike(f"[^{SPACE}]")))
    df = df.withColumn("n_words", F.size("_w").cast("long"))
    df = df.withColumn("word_chars", F.length(F.array_join("_w", "")).cast("long"))
    df = df.withColumn("n_symbols", F.length(F.regexp_replace("_t", f"[^{SYMBOLS}]+", "")).cast("long"))
    df = df.withColumn("n_dup_lines", (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long"))
    for name, step in repeat_words("_w"):
        df = df.withColumn(name, step)
    df = df.withColumn("_j", F.transform("_l", lambda x: F.struct(x.alias("line"), bad_line(x).alias("bad"))))
    lost = F.filter("_j", lambda j: j["bad"])["line"]
    df = df.withColumn("lost_chars", F.length(solid(F.array_join(lost, "\n"))).cast("long"))
    df = df.withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    df = df.withColumn("kept", ~F.col("base_failed") & (F.col("lost_chars") <= F.lit(may_lose) * F.col("word_chars")))
    good = F.filter("_j", lambda j: ~j["bad"])["line"]
    return named(df.withColumn("clean_text", F.array_join(good, "\n")))
