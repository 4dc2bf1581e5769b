"""Lemmas for forms that no table holds: edits of word ends, learned from the pairs of a lemma table.

A rule says that forms which end in ``suffix`` lose ``cut`` characters and get ``addition``. Every pair
``(form, lemma)`` is counted for all its suffixes that hold the edit, up to ``MAX_SUFFIX`` characters; the
most frequent edit of a suffix is its rule if it is frequent and clear enough. An unseen form follows the rule
of its longest suffix that has one. Rules that the next shorter suffix already gives are left out, which
changes no lemma.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from newsloom.functions.lookup import TermIndex
from newsloom.functions.sizing import is_small
from newsloom.functions.staging import stage
from newsloom.operators import features as C

MAX_SUFFIX = 5
MIN_COUNT = 2
MIN_SHARE = 0.5


def _shared_prefix(form: Column, lemma: Column) -> Column:
    """How many characters both words begin with."""
    lengths = F.sequence(F.lit(0), F.least(F.length(form), F.length(lemma)))
    return F.array_max(F.filter(lengths, lambda n: F.substring(form, F.lit(1), n) == F.substring(lemma, F.lit(1), n)))


def _suffixes(form: Column, least: Column, most: Column) -> Column:
    """The last ``least`` to ``most`` characters of a word; none if it has fewer than ``least``."""
    lengths = F.when(least <= most, F.sequence(least, most)).otherwise(F.array().cast("array<int>"))
    return F.transform(lengths, lambda n: F.when(n == 0, "").otherwise(F.right(form, n)))


def learn_lemma_rules(
    lemmas: DataFrame, max_suffix: int = MAX_SUFFIX, min_count: int = MIN_COUNT, min_share: float = MIN_SHARE
) -> DataFrame:
    """``(suffix, cut, addition, n, total)`` from ``(form, lemma)``; of equally frequent edits the one that
    cuts less, then the first in alphabetical order.

    Pairs are counted once each, whatever rows repeat. All work is grouping by suffix, with counts summed
    before they move, so the empty suffix, which all pairs have, is no large group.
    """
    pairs = lemmas.where("form is not null and lemma is not null and form <> ''").select("form", "lemma").distinct()
    kept = pairs.withColumn("kept", _shared_prefix(F.col("form"), F.col("lemma")))
    edits = kept.select(
        "form",
        (F.length("form") - F.col("kept")).alias("cut"),
        F.substring("lemma", F.col("kept") + 1, F.length("lemma")).alias("addition"),
    )
    # An end longer than ``max_suffix`` is still learned from the suffix that just holds it.
    longest = F.greatest(F.col("cut"), F.least(F.length("form"), F.lit(max_suffix)))
    counted = (
        edits.select(F.explode(_suffixes(F.col("form"), F.col("cut"), longest)).alias("suffix"), "cut", "addition")
        .groupBy("suffix", "cut", "addition")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    order = F.min(F.struct((-F.col("n")).alias("rank"), "cut", "addition"))
    best = counted.groupBy("suffix").agg(order.alias("best"), F.sum("n").alias("total"))
    rules = best.select("suffix", "best.cut", "best.addition", (-F.col("best.rank")).alias("n"), "total")
    rules = stage(rules.where((F.col("n") >= min_count) & (F.col("n") >= F.lit(min_share) * F.col("total"))), "lemma_rules")
    shorter = rules.select(F.col("suffix").alias("parent"), F.col("cut").alias("c"), F.col("addition").alias("a"))
    parent = F.expr("substring(suffix, 2)")
    joined = rules.where("suffix <> ''").withColumn("parent", parent).join(shorter, "parent", "left")
    own = joined.where("c is null or c <> cut or a <> addition").select(*rules.columns)
    return own.unionByName(rules.where("suffix = ''"))


def _edited(form: Column, cut: Column, addition: Column) -> Column:
    """The form after an edit; itself if nothing would be left."""
    edited = F.concat(F.substring(form, F.lit(1), F.length(form) - cut), addition)
    return F.when(F.length(edited) > 0, edited).otherwise(form)


def guess_lemmas(forms: DataFrame, rules: DataFrame) -> DataFrame:
    """``(form, lemma)`` of distinct forms by the rule of their longest suffix; a join, for any number of
    rules and forms. Forms without a rule are their own lemma."""
    distinct = forms.select("form").where("form is not null").distinct()
    longest_suffix = rules.agg(F.max(F.length("suffix"))).first()[0] or 0
    lengths = F.least(F.length("form"), F.lit(longest_suffix))
    suffixes = distinct.select("form", F.explode(_suffixes(F.col("form"), F.lit(0), lengths)).alias("suffix"))
    longest = F.max(F.struct(F.length("suffix").alias("length"), "cut", "addition"))
    found = suffixes.join(rules.select("suffix", "cut", "addition"), "suffix").groupBy("form").agg(longest.alias("rule"))
    edited = _edited(F.col("form"), F.col("rule.cut"), F.col("rule.addition"))
    return distinct.join(found, "form", "left").select("form", F.coalesce(edited, F.col("form")).alias("lemma"))


class SuffixTrie:
    """Rules by the characters of their suffixes from the end, for the longest one that a word has."""

    def __init__(self, rules):
        self.root: dict = {}
        for suffix, cut, addition in rules:
            node = self.root
            for character in reversed(suffix):
                node = node.setdefault(character, {})
            node[""] = (cut, addition)

    def lemma(self, form: str) -> str:
        node, rule = self.root, self.root.get("")
        for character in reversed(form):
            node = node.get(character)
            if node is None:
                break
            rule = node.get("", rule)
        if rule is None:
            return form
        return form[: len(form) - rule[0]] + rule[1] or form


def lemmatise_with_rules(tokens: DataFrame, lemmas: DataFrame, rules: DataFrame) -> DataFrame:
    """Lemmas of the table where it has them, else by the rules.

    As with ``lemmatise`` sizes decide only how: small tables are looked up inside the row, on streams as
    well, each different form of a batch once; large ones are joined.
    """
    known = lemmas.where("form is not null and lemma is not null").groupBy("form").agg(F.min("lemma").alias("lemma"))
    if tokens.isStreaming or (is_small(known) and is_small(rules)):
        if not (is_small(known) and is_small(rules)):
            raise ValueError("these lemmas are too many to look up in a row of a stream; use newsloom.streaming.tag_in_batches")
        return _by_trie(tokens, known, rules)
    kept = stage(tokens, "tokens")
    forms = kept.select(F.explode_outer("tokens").alias("form")).where("form is not null").distinct()
    guessed = guess_lemmas(forms.join(known, "form", "left_anti"), rules)
    return C.lemmatise(kept, stage(known.unionByName(guessed), "all_lemmas"))


def _by_trie(tokens: DataFrame, known: DataFrame, rules: DataFrame) -> DataFrame:
    table = known.toArrow()
    forms, found = (pa.chunked_array(table[name].chunks, pa.string()).combine_chunks() for name in ("form", "lemma"))
    rows = [tuple(r) for r in rules.select("suffix", "cut", "addition").collect()]
    sent = tokens.sparkSession.sparkContext.broadcast((TermIndex(forms), found, rows))
    tries: list[SuffixTrie] = []  # made once in each worker

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def look_up(lists: pa.Array) -> pa.Array:
        forms, found, rows = sent.value
        if not tries:
            tries.append(SuffixTrie(rows))
        flat = lists.flatten().dictionary_encode()
        words = flat.dictionary
        places = forms.find(words)
        of_table = found.take(pa.array(places, mask=places < 0))
        guessed = [tries[0].lemma(w) if lemma is None and w is not None else lemma for w, lemma in zip(words.to_pylist(), of_table.to_pylist(), strict=True)]
        terms = pa.array(guessed, pa.string()).take(flat.indices)
        return C.with_values(lists, terms)

    return tokens.withColumn("tokens", look_up("tokens"))


def prepare_tokens(texts: DataFrame, lemmas: DataFrame | None = None, rules: DataFrame | None = None) -> DataFrame:
    """Tokens of ``(id, text)`` with the lemmas of a table and of rules, if there are any."""
    tokens = C.tokenise(texts)
    if rules is not None:
        none = tokens.sparkSession.createDataFrame([], "form string, lemma string")
        return lemmatise_with_rules(tokens, none if lemmas is None else lemmas, rules)
    return tokens if lemmas is None else C.lemmatise(tokens, lemmas)
