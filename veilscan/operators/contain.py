"""Which strings lie inside which: containment by anchors, and many values looked up in texts by one automaton."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Characters of an anchor; strings shorter than that are their own.
GRAM = 4
#: Strings that share an anchor beyond which it is dealt over parts.
HOT = 10_000
#: Values, and bytes of them, that one automaton holds.
VALUES, VALUE_BYTES = 200_000, 16 << 20


def containing(inner: DataFrame, outer: DataFrame, inner_text: str, outer_text: str) -> DataFrame:
    """Distinct pairs (inner_text, outer_text) of strings of which the first lies in the second, as a whole or in part of words.

    Every piece of GRAM characters of a contained string stands in the other one too. So it is looked up by that piece of its
    own that the fewest others have, its anchor: pieces that most strings have cost nothing where a string has a rarer one,
    and a string of which any piece is nowhere is nowhere. Empty strings and nulls are in nothing. Distinct strings are
    compared; ids join back by value."""
    a = written(inner.select(F.col(inner_text).alias("a")).filter("a <> ''").distinct())
    b = written(outer.select(F.col(outer_text).alias("b")).filter("b <> ''").distinct())
    sizes = sorted(r["n"] for r in a.select(F.least(F.length("a"), F.lit(GRAM)).alias("n")).distinct().collect())  # at most GRAM
    if not sizes:
        return a.select(F.col("a").alias(inner_text), F.lit("").alias(outer_text)).limit(0)
    pieces = lambda c, n: F.when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))
    here = b.select("b", F.explode(F.array_distinct(F.concat(*[pieces(F.col("b"), F.lit(n)) for n in sizes]))).alias("piece"))
    counted = here.groupBy("piece").agg(F.count("*").alias("n"))
    own = a.select("a", F.explode(F.array_distinct(pieces(F.col("a"), F.least(F.length("a"), F.lit(GRAM))))).alias("piece"))
    found = own.join(counted, "piece", "left").groupBy("a").agg(F.min_by("piece", "n").alias("piece"), F.min("n").alias("n"), F.bool_and(F.col("n").isNotNull()).alias("every"))
    anchors = found.filter("every")
    # an anchor that very many strings have is dealt over parts there, and asked in every part
    hot = counted.filter(F.col("n") > HOT).select("piece", F.ceil(F.col("n") / HOT).alias("parts"))
    dealt = here.join(F.broadcast(anchors.filter(F.col("n") > HOT).select("piece").distinct().join(hot, "piece")), "piece", "left")
    dealt = dealt.select("b", "piece", F.pmod(F.xxhash64("b"), F.coalesce("parts", F.lit(1))).alias("part"))
    asked = anchors.select("a", "piece", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / HOT), F.lit(1)) - 1)).alias("part"))
    return asked.join(dealt, ["piece", "part"]).filter(F.contains("b", "a")).select(F.col("a").alias(inner_text), F.col("b").alias(outer_text))


def words_of(text: str) -> list[str]:
    """The words of a text in lower case: runs of letters and digits."""
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def gazetted(docs: DataFrame, values: DataFrame, most: int = VALUES) -> DataFrame:
    """(doc_id, type, normalized) of the (type, value) rows whose words follow one another in a (doc_id, text) row, whatever the case.

    Values are dealt into parts of bounded size; of each part an automaton over its values' words (a trie with failure links) reads every text
    once, whatever the lengths of values, and no text is shuffled or cut into runs of words. Null texts and values
    and values without a word match nothing; a value that stands in a text more than once gives one row."""
    v = values.filter("value is not null").select("type", F.trim("value").alias("normalized")).distinct()
    sized = v.agg(F.count("*").alias("n"), F.sum(F.octet_length("normalized")).alias("bytes")).first()
    parts = max(-(-sized["n"] // most), -(-(sized["bytes"] or 0) // VALUE_BYTES))
    v = written(v.withColumn("part", F.pmod(F.xxhash64("type", "normalized"), F.lit(max(parts, 1)))))
    texts, context = docs.filter("text is not null").select("doc_id", "text"), docs.sparkSession.sparkContext
    schema = docs.select("doc_id", F.lit("").alias("type"), F.lit("").alias("normalized")).schema
    found = None
    for part in range(parts):
        held = context.broadcast([tuple(r) for r in v.filter(F.col("part") == part).select("type", "normalized").collect()])

        def run(batches, held=held):
            import ahocorasick
            import pandas as pd

            automaton, by_words = ahocorasick.Automaton(), {}
            for kind, value in held.value:
                if words := words_of(value):
                    by_words.setdefault(f" {' '.join(words)} ", []).append((kind, value))
            for words, rows in by_words.items():
                automaton.add_word(words, rows)
            if not by_words:
                return
            automaton.make_automaton()
            for batch in batches:
                rows = []
                for doc, text in zip(batch["doc_id"], batch["text"]):
                    seen = {row for _, hits in automaton.iter(f" {' '.join(words_of(text))} ") for row in hits}
                    rows += [(doc, *row) for row in seen]
                yield pd.DataFrame(rows, columns=["doc_id", "type", "normalized"])

        hits = texts.mapInPandas(run, schema)
        found = hits if found is None else found.unionByName(hits)
    return texts.limit(0).select("doc_id", F.lit("").alias("type"), F.lit("").alias("normalized")) if found is None else found.distinct()
