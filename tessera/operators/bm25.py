"""BM25 rankings, a batch of queries at a time.

All rankings read an index (see ``index``) and start from the query tokens: postings are cut to those by a semi join
before anything is grouped, so a token that most rows hold costs only if a query asks for it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.config import LEGAL, Profile
from tessera.functions.text import asks_year, query_tokens, strip_marks, tokens, without_stop
from tessera.operators.index import Index, _paired, of_classes, on_shelf, shelf
from tessera.runtime import cut, settled

K1, B = 1.2, 0.75


def _weight(weights: Mapping[str, float] | None) -> Column:
    w = F.lit(1.0)
    for name, value in (weights or {}).items():
        w = F.when(F.col("field") == name, F.lit(float(value))).otherwise(w)
    return w * F.col("n")


def _weighted(weights: Mapping[str, float] | None) -> Column:
    return F.sum(_weight(weights)).alias("f")


def _idf() -> Column:
    idf = F.log((F.col("units") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)


def _share(f: Column) -> Column:
    """What ``f`` occurrences in a unit of ``len`` tokens weigh: it rises with f and falls with len."""
    return f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))


def _part(ix: Index, rows: DataFrame) -> DataFrame:
    """``rows`` (ref, f, df, len, ..) with ``part``: what a token adds to a unit's score."""
    # One row of statistics beside every posting: a broadcast of one row.
    return rows.crossJoin(F.broadcast(ix.totals)).withColumn("part", _idf() * _share(F.col("f"))).drop("units", "avgdl", "len")


def _summed() -> Column:
    return (-F.sum(F.col("part") * F.col("times"))).alias("score")


def score(ix: Index, terms: DataFrame, weights: Mapping[str, float] | None = None, pairs: bool = False) -> DataFrame:
    """qid, ref, hits (distinct terms found), score (negative: better is less) of all units with any of ``terms`` (qid, tok, times).

    The terms are words or, with ``pairs``, pairs of words; field weights scale the occurrences. Only folders of asked shelves are read.
    """
    wanted = on_shelf(terms.select("tok").distinct())
    tf = (ix.pairs if pairs else ix.words).join(wanted, ["shelf", "tok"], "left_semi").groupBy("ref", "tok", "len").agg(_weighted(weights))
    df = tf.groupBy("tok").agg(F.count("f").alias("df")) if pairs else ix.frequencies
    parts = _part(ix, tf.join(df, "tok")).select("ref", "tok", "part")
    return terms.join(parts, "tok").groupBy("qid", "ref").agg(F.count("*").alias("hits"), _summed())


#: Units that one task ranks all queries over, the least number of such blocks, and how far scores are apart that rounding may have parted.
UNITS, LEAST_BLOCKS, NEAR = 65_536, 16, 2e-9


def best(ix: Index, terms: DataFrame, limit: int, weights: Mapping[str, float] | None = None, pairs: bool = False) -> DataFrame:
    """The first ``limit`` per query of ``score`` or, where ``terms`` tell their number ``n``, of ``score_all``: qid, ref, score, pos.

    Units are dealt to blocks, and each block ranks every query over its own postings in arrays, twice. At first a few scores of a query leave a block, some twice ``limit``
    over all blocks; the last of the ``limit`` best of them is what a unit has to reach, for so many reach it. Then what reaches it leaves, ``limit`` rows of a block at most.
    So what is shuffled grows with the units and with the queries, not with their matches nor with queries times blocks; postings are dealt once for both."""
    every = "n" in terms.columns
    held = ix.pairs if pairs else ix.words
    asked = terms.select("tok").distinct()
    if pairs:
        df = held.join(F.broadcast(on_shelf(asked)), ["shelf", "tok"], "left_semi").select("tok", "ref").distinct().groupBy("tok").agg(F.count("*").alias("df"))
    else:
        df = ix.frequencies
    known = cut(asked.join(df, "tok").crossJoin(F.broadcast(ix.totals)).select("tok", F.monotonically_increasing_id().alias("id"), _idf().alias("idf")))
    units = ix.totals.first()["units"]
    blocks = max(LEAST_BLOCKS, -(-units // UNITS))
    # The distinct tokens of a batch of queries go to the postings, as they do when an index is built for them; by the size of its files an index looks small.
    dealt = held.join(F.broadcast(on_shelf(known.select("tok", "id"))), ["shelf", "tok"])
    dealt = dealt.select(F.pmod(F.xxhash64("ref"), F.lit(blocks)).cast("int").alias("block"), "ref", "id", "len", _weight(weights).alias("f")).repartition("block")
    f = dealt.groupBy("block", "ref", "id", "len").agg(F.sum("f").alias("f"))
    posts = f.crossJoin(F.broadcast(ix.totals)).select("block", "ref", "id", _share(F.col("f")).alias("share"))
    n = F.col("n") if every else F.lit(0)
    wanted = terms.join(known, "tok").select("qid", "id", (F.col("times") * F.col("idf")).alias("w"), n.cast("int").alias("n"))
    qkind, kind = terms.schema["qid"].dataType.simpleString(), held.schema["ref"].dataType.simpleString()

    def ranked(most: int):
        def of_block(mine: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
            found = [(told["qid"].to_numpy()[:0], mine["ref"].to_numpy()[:0], np.zeros(0))]
            if len(mine) and len(told):
                refs, unit = np.unique(mine["ref"].to_numpy(), return_inverse=True)
                order = np.lexsort((unit, mine["id"].to_numpy()))
                ids, first = np.unique(mine["id"].to_numpy()[order], return_index=True)
                unit, share, first = unit[order], mine["share"].to_numpy()[order], np.append(first, len(order))
                told = told.sort_values(["qid", "id"])
                at = np.searchsorted(ids, told["id"].to_numpy())
                here = ids[np.minimum(at, len(ids) - 1)] == told["id"].to_numpy()
                qid, w, need, least = told["qid"].to_numpy(), told["w"].to_numpy(), told["n"].to_numpy(), told["least"].to_numpy(dtype=float)
                starts = np.flatnonzero(np.append(True, qid[1:] != qid[:-1]))
                for s, e in zip(starts, np.append(starts[1:], len(qid)), strict=True):
                    terms_of = [(at[i], w[i]) for i in range(s, e) if here[i]]
                    if not terms_of or (every and len(terms_of) < need[s]):
                        continue
                    if every:
                        terms_of.sort(key=lambda x: first[x[0] + 1] - first[x[0]])
                        u = unit[first[terms_of[0][0]] : first[terms_of[0][0] + 1]]
                        total = np.zeros(len(u))
                        for k, weight in terms_of:
                            own = unit[first[k] : first[k + 1]]
                            place = np.minimum(np.searchsorted(own, u), len(own) - 1)
                            both = own[place] == u
                            u, total = u[both], total[both] + weight * share[first[k] + place[both]]
                    else:
                        u = np.concatenate([unit[first[k] : first[k + 1]] for k, _ in terms_of])
                        total = np.bincount(u, np.concatenate([x * share[first[k] : first[k + 1]] for k, x in terms_of]))
                        u = np.flatnonzero(np.bincount(u))
                        total = total[u]
                    score = np.round(-total, 9)
                    if not np.isnan(least[s]):
                        near = np.flatnonzero(score <= least[s] + NEAR)
                        u, total, score = u[near], total[near], score[near]
                    if len(u) > most:
                        near = np.flatnonzero(score <= np.partition(score, most - 1)[most - 1])
                        u, total, score = u[near], total[near], score[near]
                    top = np.lexsort((u, score))[:most]
                    found.append((np.full(len(top), qid[s]), refs[u[top]], -total[top]))
            return pd.DataFrame({"qid": np.concatenate([x for x, _, _ in found]), "ref": np.concatenate([x for _, x, _ in found]), "score": np.concatenate([x for _, _, x in found])})

        return of_block

    def scored(told: DataFrame, most: int) -> DataFrame:
        told = told.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return posts.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(ranked(most), f"qid {qkind}, ref {kind}, score double")

    few = scored(wanted.withColumn("least", F.lit(None).cast("double")), min(limit, -(-2 * limit // blocks) + 2)).select("qid", F.round("score", 9).alias("score"))
    # Some twice ``limit`` numbers a query.
    last = few.groupBy("qid").agg(F.get(F.sort_array(F.collect_list("score")), F.lit(limit - 1)).alias("least"))
    return rank(scored(wanted.join(last, "qid", "left"), limit), limit)


#: Share of a query's postings that is scored first, those of its rarest tokens, and what a bound may lack by rounding.
EARLY, SLACK = 0.2, 1e-6


def _parts(ix: Index, asked: DataFrame, on: Sequence[str], weights: Mapping[str, float] | None) -> DataFrame:
    """qid, ref, block, part: what the tokens of ``asked`` (qid, .., tok, shelf, times, df, units, avgdl) add to units."""
    f = ix.words.join(on_shelf(asked), list(on)).groupBy("qid", "ref", "block", "tok", "len", "times", "df", "units", "avgdl").agg(_weighted(weights))
    return f.groupBy("qid", "ref", "block").agg(F.sum(F.col("times") * _idf() * _share(F.col("f"))).alias("part"))


@dataclass(frozen=True)
class Bounded:
    """The state of a bounded ranking: ``early`` (qid, ref, block, part) of each query's rarest tokens, ``later`` its other tokens, ``near``
    (qid, ref, part) the units whose bound reaches the last place, ``open`` (qid, block) where tokens of ``later`` alone could reach it."""

    early: DataFrame
    later: DataFrame
    near: DataFrame
    open: DataFrame


def bounded(ix: Index, terms: DataFrame, limit: int, weights: Mapping[str, float] | None = None) -> Bounded:
    """Scores the postings of each query's rarest tokens, EARLY of all its postings; the last of the ``limit`` best so far is what every
    other unit has to reach. In a block of units of like length the later tokens add no more than the most occurrences at the
    least length of one; a unit that cannot make up for the rest by that is out, and a block where they alone stay below is closed."""
    most = max([1.0, *(weights or {}).values()])
    by_df = Window.partitionBy("qid").orderBy("df", "tok")
    known = terms.join(ix.frequencies, "tok").withColumns({"so_far": F.sum("df").over(by_df), "all": F.sum("df").over(Window.partitionBy("qid")), "place": F.row_number().over(by_df)})
    known = known.withColumn("first", (F.col("place") == 1) | (F.col("so_far") <= EARLY * F.col("all"))).crossJoin(F.broadcast(ix.totals))
    known = cut(known.select("qid", "tok", "times", "df", "units", "avgdl", "first", shelf(F.col("tok")).alias("shelf")))
    early, later = cut(_parts(ix, known.filter("first"), ["shelf", "tok"], weights)), known.filter("NOT first")
    last = rank(early.withColumn("score", -F.col("part")), limit).filter(F.col("pos") == limit).select("qid", (F.col("part") - SLACK).alias("least"))
    bound = F.sum(F.col("times") * _idf() * _share(most * F.col("n"))).alias("more")
    more = cut(ix.bounds.drop("df").join(on_shelf(later), ["shelf", "tok"]).groupBy("qid", "block").agg(bound).join(last, "qid", "left"))
    opened = more.filter(F.col("least").isNull() | (F.col("more") >= F.col("least"))).select("qid", "block")
    # Where nothing can be added ``more`` has no row; where the limit was not reached every block is open.
    near = early.join(last, "qid", "left").join(more.drop("least"), ["qid", "block"], "left")
    near = near.filter(F.col("least").isNull() | (F.col("part") + F.coalesce("more", F.lit(0.0)) >= F.col("least"))).select("qid", "ref", "block", "part")
    return Bounded(early, later, cut(near), opened)


#: Postings of all queries below which scoring them outright, in arrays, costs less than finding out which ones count.
OUTRIGHT = 20_000_000_000


def top(ix: Index, terms: DataFrame, limit: int, weights: Mapping[str, float] | None = None, outright: int = OUTRIGHT) -> DataFrame:
    """The first ``limit`` per query of ``score`` (qid, ref, score, pos); of ``outright`` postings or more, what cannot reach them is not scored."""
    if (terms.join(ix.frequencies, "tok").agg(F.sum("df")).first()[0] or 0) < outright:
        return best(ix, terms.select("qid", "tok", "times"), limit, weights)
    b = bounded(ix, terms, limit, weights)
    closed = b.near.join(b.open, ["qid", "block"], "left_anti").select("qid", "ref")
    looked_up = _parts(ix, closed.join(b.later, "qid"), ["shelf", "tok", "ref"], weights)
    scanned = _parts(ix, b.open.join(b.later, "qid"), ["shelf", "tok", "block"], weights)
    # In open blocks a unit counts that only later tokens hold, or whose early ones alone were too little.
    early = b.near.unionByName(b.early.join(b.open, ["qid", "block"], "left_semi").join(b.near.select("qid", "ref"), ["qid", "ref"], "left_anti"))
    parts = early.unionByName(looked_up).unionByName(scanned)
    return rank(parts.groupBy("qid", "ref").agg((-F.sum("part")).alias("score")), limit)


def top_by_class(u: DataFrame, terms: DataFrame, limit: int, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The same as ``top`` over the index of units ``u`` (ref, field, text), where many units, or many queries, are the same: each distinct query is asked once
    and each distinct unit scored once. Units of one text tie, so the first ``limit`` classes by their smallest refs hold the first ``limit`` units."""
    ix, members = of_classes(u, limit)
    asked = cut(terms.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("tok", "times"))).alias("t")))
    one = cut(asked.groupBy("t").agg(F.min("qid").alias("rep")))
    ranked = top(ix, one.select(F.col("rep").alias("qid"), F.explode("t").alias("c")).select("qid", "c.tok", "c.times"), limit, weights)
    units = ranked.select("qid", F.col("ref").alias("rep"), "score").join(members, "rep").select("qid", "ref", "score")
    first = rank(units, limit).withColumnRenamed("qid", "rep")
    return asked.join(one, "t").select("qid", "rep").join(first, "rep").select("qid", "ref", "score", "pos")


def score_all(ix: Index, terms: DataFrame, weights: Mapping[str, float] | None = None) -> DataFrame:
    """The same as ``score`` of the units that hold every one of a query's ``terms`` (qid, n, tok, times). Each query starts from the units of
    its rarest token; of the other tokens' postings only those of these units are kept, before anything is grouped."""
    known = terms.withColumnRenamed("n", "m").join(ix.frequencies, "tok")
    least = known.groupBy("qid", "m").agg(F.count("*").alias("known"), F.min(F.struct("df", "tok")).alias("least")).filter("known = m")
    rarest = on_shelf(least.select("qid", F.col("least.tok").alias("tok")))
    likely = rarest.join(ix.words.select("shelf", "tok", "ref"), ["shelf", "tok"]).select("qid", "ref").distinct()
    pairs = likely.join(known, "qid").withColumn("shelf", shelf(F.col("tok"))).join(ix.words, ["shelf", "tok", "ref"])
    # A row per (query, unit, term) from a row per field.
    f = pairs.groupBy("qid", "ref", "tok", "m", "times", "df", "len").agg(_weighted(weights))
    return _part(ix, f).groupBy("qid", "ref", "m").agg(F.count("*").alias("hits"), _summed()).filter("hits = m").drop("m")


def rank(scored: DataFrame, limit: int, *before: Column) -> DataFrame:
    """The first ``limit`` per query with ``pos`` from 1; ties by ref."""
    w = Window.partitionBy("qid").orderBy(*before, F.round("score", 9), "ref")
    return scored.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit)


def or_terms(queries: DataFrame, profile: Profile = LEGAL) -> DataFrame:
    """All distinct query tokens: (qid, tok, times)."""
    t = F.array_distinct(query_tokens(F.col("text"), profile.query_chars, profile.query_tokens))
    return queries.select("qid", F.explode(t).alias("tok")).withColumn("times", F.lit(1))


def and_terms(queries: DataFrame, profile: Profile = LEGAL) -> DataFrame:
    """Distinct tokens without function words: (qid, tok, times, n of the query)."""
    t = query_tokens(F.col("text"), profile.query_chars, profile.query_tokens)
    t = F.array_distinct(without_stop(t, profile.stop))
    return queries.select("qid", F.size(t).alias("n"), F.explode(t).alias("tok")).withColumn("times", F.lit(1))


def phrases(queries: DataFrame, df: DataFrame, profile: Profile = LEGAL) -> DataFrame:
    """qid, i, a, b, min_df: the adjacent pairs of the filtered tokens with the least frequent
    member first, at most ``profile.phrases`` per query; ``df`` is (tok, df), 0 where it lacks a token."""
    t = without_stop(query_tokens(F.col("text"), profile.query_chars, profile.query_tokens), profile.stop)
    q = queries.select("qid", t.alias("t")).filter(F.size("t") >= 2)
    pairs = F.transform(F.slice("t", F.lit(1), F.size("t") - 1), lambda x, i: F.struct(x.alias("a"), F.get("t", i + 1).alias("b")))
    p = q.select("qid", F.posexplode(pairs).alias("i", "p")).select("qid", "i", "p.a", "p.b")
    one = lambda c: df.select(F.col("tok").alias(c), F.col("df").alias(f"df_{c}"))
    p = p.join(one("a"), "a", "left").join(one("b"), "b", "left")
    p = p.withColumn("min_df", F.least(F.coalesce("df_a", F.lit(0)), F.coalesce("df_b", F.lit(0))))
    r = F.row_number().over(Window.partitionBy("qid").orderBy("min_df", "i"))
    return p.withColumn("r", r).filter(F.col("r") <= profile.phrases).select("qid", "i", "a", "b", "min_df", "r")


def asked(queries: DataFrame, profile: Profile = LEGAL) -> DataFrame:
    """tok: all words of the queries, and their pairs as they stand and without function words: what any ranking here, or the search for a whole
    text, can ask an index for."""
    t, few = tokens(F.col("text")), without_stop(query_tokens(F.col("text"), profile.query_chars, profile.query_tokens), profile.stop)
    told = queries.select(t.alias("t"), few.alias("few"))
    return told.select(F.explode(F.concat("t", _paired(F.col("t")), _paired(F.col("few")))).alias("tok")).distinct()


def phrase_terms(queries: DataFrame, df: DataFrame, profile: Profile = LEGAL) -> DataFrame:
    """Phrases as terms over bigrams; a phrase that the query repeats counts each time."""
    p = phrases(queries, df, profile)
    return p.groupBy("qid", F.concat_ws(" ", "a", "b").alias("tok")).agg(F.count("*").alias("times"))


def cascade(ix: Index, queries: DataFrame, limit: int, weights: Mapping[str, float] | None = None, profile: Profile = LEGAL) -> DataFrame:
    """Rows with all tokens first; where they do not fill the limit, rows with a rare phrase after
    them: only queries that the first stage left short are asked by phrase. qid, ref, stage, score, pos."""
    full = cut(best(ix, and_terms(queries, profile), limit, weights).select("qid", "ref", F.lit(1).alias("stage"), "score"))
    settled(queries.sparkSession)
    short = queries.join(full.groupBy("qid").agg(F.count("*").alias("__n")).filter(F.col("__n") >= limit), "qid", "left_anti")
    # Fewer than ``limit`` of them are rows of the first stage, so twice as many leave enough of the others.
    some = best(ix, phrase_terms(short, ix.frequencies, profile), 2 * limit, weights, pairs=True)
    both = full.unionByName(some.select("qid", "ref", F.lit(2).alias("stage"), "score"))
    first = both.groupBy("qid", "ref").agg(F.min_by(F.struct("stage", "score"), "stage").alias("s")).select("qid", "ref", "s.*")
    return rank(first, limit, F.col("stage"))


#: Beginnings of titles that change other documents, and the words that ask for them.
AMENDING = ("sua doi", "bai bo", "dinh chinh", "huong dan")
AMEND = "sua doi"


def doc_boost(query: Column, doc_type: Column, year: Column, expired: Column, title: Column) -> Column:
    """The factor on a document's score: kind named in the query, recent, valid, no amendment."""
    q, kind, name = strip_marks(query), strip_marks(doc_type), strip_marks(title)
    amends = F.lit(False)
    for a in AMENDING:
        amends = amends | F.startswith(name, F.lit(a))
    known = ~asks_year(query) & (F.coalesce(year, F.lit(0)) != 0)
    recent = F.least(F.greatest(year - 1990, F.lit(0)), F.lit(40)) * 0.006
    return (
        F.lit(1.0)
        + F.when((q != "") & (kind != "") & F.contains(q, kind), 0.12).otherwise(0.0)
        + F.when(known, recent).otherwise(0.0)
        - F.when(F.coalesce(expired, F.lit(0)) != 0, 0.30).otherwise(0.0)
        - F.when(amends & ~F.contains(q, F.lit(AMEND)), 0.28).otherwise(0.0)
    )


def rank_docs(candidates: DataFrame, docs: DataFrame, queries: DataFrame, limit: int) -> DataFrame:
    """Candidates (qid, ref, score) by tier and boost: qid, ref, final, pos. ``docs``: ref, doc_type, year, expired, title, tier."""
    c = candidates.select("qid", "ref", "score").join(docs, "ref").join(queries.select("qid", F.col("text").alias("__q")), "qid")
    factor = 1.0 + 0.18 * (3 - F.coalesce("tier", F.lit(3)))
    c = c.withColumn("final", F.col("score") * factor * doc_boost(F.col("__q"), F.col("doc_type"), F.col("year"), F.col("expired"), F.col("title")))
    w = Window.partitionBy("qid").orderBy(F.round("final", 9), "ref")
    return c.withColumn("pos", F.row_number().over(w)).filter(F.col("pos") <= limit).drop("__q")


def n_tokens(text: Column) -> Column:
    return F.size(tokens(text))
