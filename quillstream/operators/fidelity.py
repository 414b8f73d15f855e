"""Names in prose that its source never mentions: an anchored prefix matcher as one column expression."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import trim_to_alphanumeric

#: Characters from which a source's word vouches for longer tokens that begin with it.
STEM = 3


def comparable(token: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.replace(F.lower(F.regexp_replace(token, r"[^\p{L}\p{N}]+", "")), F.lit("ß"), F.lit("ss"))


def source_words(text: Column) -> Column:
    """A text's words in comparable form, in reading order."""
    return F.filter(F.transform(F.split(text, r"(?U)\s+"), comparable), lambda w: w != "")


def is_checkable(token: Column) -> Column:
    """Whether a token is a name in any language: letters with digits, or a capital after its first letter, but not all capitals."""
    letters = F.regexp_replace(token, r"[^\p{L}]+", "")
    inner = letters.rlike(r"^\p{L}.*\p{Lu}") & ~letters.rlike(r"^\p{Lu}+$")
    return (letters != "") & (token.rlike(r"\p{Nd}") | inner)


def supported(words: Column, token: Column) -> Column:
    """Whether a word, or up to three in a row merged, vouches for a comparable token.

    Merging goes on only while the stem is shorter than STEM, so that three words settle it.
    """

    def at(i: Column) -> Column:
        one = F.get(words, i)
        two = F.concat(one, F.coalesce(F.get(words, i + 1), F.lit("")))
        three = F.concat(two, F.coalesce(F.get(words, i + 2), F.lit("")))

        def vouches(stem: Column) -> Column:
            return stem.startswith(token) | (token.startswith(stem) & (F.length(stem) >= STEM))

        def goes_on(stem: Column) -> Column:
            return (F.length(stem) < STEM) & token.startswith(stem)

        return vouches(one) | (goes_on(one) & (vouches(two) | (goes_on(two) & vouches(three))))

    return (token != "") & F.exists(F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0))), lambda i: F.coalesce(at(i), F.lit(False)))


def unsupported_entities(prose: DataFrame, sources: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, article_id, field, token): checkable tokens of prose that the article's source text doesn't support.

    prose: (*by, article_id, field, text), where `by` tells texts about the same article
    apart.  sources: (article_id, text).  A token counts once per field, in the first spelling.
    """
    split = prose.select(*by, "article_id", "field", F.posexplode(F.split("text", r"(?U)\s+")).alias("at", "raw")).withColumn("token", trim_to_alphanumeric(F.col("raw")))
    tokens = split.where((F.col("token") != "") & is_checkable(F.col("token"))).groupBy(*by, "article_id", "field", F.lower("token").alias("folded")).agg(F.min_by("token", F.struct("at", "token")).alias("token"))
    # A text is joined once, with all tokens of its article, and its words are made once.
    gathered = tokens.groupBy("article_id").agg(F.collect_list(F.struct(*by, "field", "token")).alias("said"))
    words = sources.select("article_id", source_words(F.col("text")).alias("words"))
    checked = gathered.join(words, "article_id").select("article_id", F.filter("said", lambda x: ~supported(F.col("words"), comparable(x["token"]))).alias("said"))
    return checked.select("article_id", F.inline("said")).select(*by, "article_id", "field", "token")
