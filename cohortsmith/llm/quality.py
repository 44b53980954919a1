"""Quality rules: clean line by line first, then judge what is left.

Every line is tested on its own: punctuation, navigation, boilerplate.  Lines that
fail are removed.  A document that loses too many of its words this way is rejected,
and so is one that fails the base rules (too short, too repetitive).  Everything is
computed inside the row from arrays of its words and lines, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortsmith.llm.tables import WHITE_SPACE, WORD, column, let

SYMBOLS = "#*$%&|<>"
GAPS = r"[\x20\x09-\x0D]+"

MIN_WORDS = 50
MAX_REPEATED = 50  # per cent of the words
MAX_LOST = 40  # per cent of the words in removed lines

# Punctuation: a line fails with more symbol characters than this share of its words.
MAX_SYMBOLS = 20  # per cent
# Navigation: a line fails with this many words or fewer and no closing mark, or when
# so many of its words (per cent) are separators.
SHORT_LINE = 2
CLOSING = ".!?\"')]:;,…。"
MAX_SEPARATORS = 20
# Shouting: a line fails when so many of its words end in two exclamation marks.
MAX_SHOUTS = 30
# Boilerplate: phrases of page furniture, in lower case.
BOILERPLATE = (
    "all rights reserved", "cookie policy", "enable javascript", "javascript is disabled",
    "lorem ipsum", "privacy policy", "terms of service", "terms of use", "click here",
    "sign in", "log in", "subscribe to our", "use cookies",
)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("long")


def _words(text: Column) -> Column:
    return F.array_remove(F.split(text, GAPS), "")


def _without(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def n_symbols(text: Column) -> Column:
    return (F.length(text) - F.length(_without(text, SYMBOLS))).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    filled = F.filter(F.split(text, "\n"), lambda line: F.length(_without(line, WHITE_SPACE)) > 0)
    return let(filled, lambda lines: F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def n_repeat_words(text: Column) -> Column:
    """Words inside 3-word windows that occur at least twice.

    A window is a hash shifted up to make room for its position; one sort of these
    numbers brings equal windows together.  With ``b`` bits for positions the hash
    keeps ``64 - b``, so windows of equal hash are sorted again by their words, and
    only equal words count.
    """

    def of_words(words: Column) -> Column:
        return let(
            F.transform(words, lambda w: F.xxhash64(w)), lambda hashes: of_hashes(words, hashes)
        )

    def of_hashes(words: Column, hashes: Column) -> Column:
        n = F.size(hashes)
        bits = F.ceil(F.log2(n + F.lit(1))).cast("int")

        def keyed(bits: Column) -> Column:
            windows = F.transform(
                F.slice(hashes, 1, n - 2),
                lambda h, i: F.call_function(
                    "shiftleft",
                    F.xxhash64(h, F.get(hashes, i + 1), F.get(hashes, i + 2)), bits,
                ).bitwiseOR(i.cast("long")),
            )
            return let(F.sort_array(windows), lambda keys: covered(keys, bits))

        def covered(keys: Column, bits: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                other = F.call_function("shiftright", a.bitwiseXOR(b), bits)
                return F.coalesce(other == 0, F.lit(False))

            repeated = F.filter(
                keys,
                lambda k, i: same(k, F.get(keys, i + 1))
                | F.when(i > 0, same(k, F.get(keys, F.greatest(i - 1, F.lit(0))))).otherwise(False),
            )
            low = F.call_function("shiftleft", F.lit(1).cast("long"), bits) - 1
            spelled = F.sort_array(F.transform(repeated, lambda k: let(
                k.bitwiseAND(low).cast("int"),
                lambda p: F.struct(
                    *[F.get(words, p + j).alias(f"w{j}") for j in range(3)], p.alias("p")
                ),
            )))
            return let(let(spelled, equal), added_up)

        def equal(found: Column) -> Column:
            def same(a: Column, b: Column) -> Column:
                return F.coalesce(
                    (a["w0"] == b["w0"]) & (a["w1"] == b["w1"]) & (a["w2"] == b["w2"]),
                    F.lit(False),
                )

            repeated = F.filter(
                found,
                lambda x, i: same(x, F.get(found, i + 1))
                | F.when(i > 0, same(x, F.get(found, F.greatest(i - 1, F.lit(0))))).otherwise(False),
            )
            return F.sort_array(F.transform(repeated, lambda x: x["p"].cast("long")))

        def added_up(at: Column) -> Column:
            return F.aggregate(
                F.transform(at, lambda p, i: F.least(
                    F.lit(3).cast("long"), F.coalesce(F.get(at, i + 1) - p, F.lit(3).cast("long"))
                )),
                F.lit(0).cast("long"), lambda total, more: total + more,
            )

        return F.when(n < 4, F.lit(0).cast("long")).otherwise(let(bits, keyed))

    return let(_words(text), of_words)


def bad_line(line: Column) -> Column:
    """Whether the line breaks one of the line rules; a line without words does not."""
    bare = F.regexp_replace(line, r"[\x20\x09-\x0D]+$", "")
    n = _count(line, WORD)
    symbols = 100 * n_symbols(line) > MAX_SYMBOLS * n
    separators = 100 * _count(line, r"[|»•·>]") > MAX_SEPARATORS * n
    shouts = 100 * _count(line, r"!!") > MAX_SHOUTS * n
    open_end = ~F.contains(F.lit(CLOSING), F.right(bare, F.lit(1)))
    low = F.lower(line)
    furniture = F.lit(False)
    for phrase in BOILERPLATE:
        furniture = furniture | F.contains(low, F.lit(phrase))
    return (n > 0) & (
        symbols | separators | shouts | furniture | ((n <= SHORT_LINE) & open_end)
    )


def judge(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Counts, cleaned text and verdict per row.

    Returns ``id_column``, ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``kept``, ``n_lines_removed``,
    ``words_removed`` and ``clean_text`` (the lines that passed, in order).  NULL text
    has no words and fails the base rules like an empty one; rows are judged
    independently of each other; an empty table gives an empty result.
    """
    text = F.coalesce(column(docs, text_column), F.lit(""))
    counted = docs.select(column(docs, id_column).alias("id"), text.alias("text")).select(
        "id",
        _count(F.col("text"), WORD).alias("n_words"),
        F.length(_without(F.col("text"), WHITE_SPACE)).cast("long").alias("word_chars"),
        n_symbols(F.col("text")).alias("n_symbols"),
        n_dup_lines(F.col("text")).alias("n_dup_lines"),
        n_repeat_words(F.col("text")).alias("n_repeat_words"),
        F.transform(
            F.split(F.col("text"), "\n"),
            lambda line: F.struct(
                line.alias("line"), bad_line(line).alias("bad"),
            ),
        ).alias("lines"),
    )
    bad = F.filter("lines", lambda x: x["bad"])
    lost = F.aggregate(
        F.transform(bad, lambda x: _count(x["line"], WORD)), F.lit(0).cast("long"),
        lambda total, more: total + more,
    )
    good = F.transform(F.filter("lines", lambda x: ~x["bad"]), lambda x: x["line"])
    judged = counted.select(
        F.col("id").alias(id_column), "n_words", "word_chars", "n_symbols", "n_dup_lines",
        "n_repeat_words",
        (
            (F.col("n_words") < MIN_WORDS)
            | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))
        ).alias("base_failed"),
        F.size(bad).cast("long").alias("n_lines_removed"),
        lost.alias("words_removed"),
        F.array_join(good, "\n").alias("clean_text"),
    )
    return judged.withColumn(
        "kept",
        ~F.col("base_failed")
        & (100 * F.col("words_removed") <= MAX_LOST * F.col("n_words")),
    )
