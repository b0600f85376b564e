"""Operators 11 to 13 against plain Python on odd rows, and against their SQL on a folder of tables."""

import hashlib
import os
import re
from collections import defaultdict
from itertools import permutations

import pytest
from compare import expected, rows_of
from conftest import odd_rows
from pyspark.sql import functions as F

from statloom.llm import op11_mixing, op12_fim, op13_filter_audit
from statloom.llm.common import Shared
from statloom.llm.queries import QUERIES, SQL

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("name", ["op11_hash_mixing", "op12_fill_in_middle", "op13_filter_audit"])
def test_sql(spark, name):
    assert rows_of(QUERIES[name](spark, FOLDER).toPandas()) == expected(SQL[name], FOLDER)


def fim_plain(doc, text):
    text = text or ""
    digest = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return "plain", None, None, text
    pre, mid, suf = text[:a], text[a:b], text[b:]
    return ("spm", a, b - a, f"<S>{suf}<P>{pre}<M>{mid}") if h[3] % 100 < 20 else ("psm", a, b - a, f"<P>{pre}<S>{suf}<M>{mid}")


def test_fill_in_middle(spark, odd, no_rows):
    extra = [(100 + k, t) for k, t in enumerate(["has <M> in it", "<", "<S", "a<P", "<<S><", "P>x<S", "\U0001f600" * 50, "x\r\n\x00y", "<P", "M>"] * 12)]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    made = op12_fim.arranged(docs.select("doc_id", F.col("text"), F.lit(1).alias("n"), F.lit(2).alias("form")), F.struct("doc_id", "text").alias("row"))
    rows = made.select("row.*", "n", "form", "prefix_chars", "middle_chars", "output", op12_fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert len(rows) == docs.count()
    assert {r["form"] for r in rows} == {"plain", "psm", "spm"}
    for r in rows:
        assert (r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == fim_plain(r["doc_id"], r["text"])
        assert r["back"] == (r["text"] or "") and r["n"] == len(r["text"] or "")
    assert op12_fim.arranged(no_rows, F.col("doc_id")).count() == 0
    whole = op12_fim.transformed(odd)
    assert whole.columns == [*odd.columns, "form"]
    assert {(r["doc_id"], r["text"], r["n_chars"]) for r in whole.collect()} == {(d, fim_plain(d, t)[3], len(fim_plain(d, t)[3])) for d, t, *_ in odd_rows()}


def mask_plain(text):
    words = WORD.findall(text)
    return [len(words) < 200, 100 * len(set(words)) < 50 * len(words), 100 * sum("A" <= c <= "Z" for c in text) > 2 * len(text), any(c in "#$%&*|" for c in text)]


def audit_plain(docs, labels):
    least = {}
    for doc, text, _ in docs:
        if doc is not None:
            least[text or ""] = min(doc, least.get(text or "", doc))
    good = {d for d, q, _ in labels if d is not None and q == 1}
    toxic = {d for d, _, t in labels if d is not None and t == 1}
    parts = defaultdict(list)
    for doc, text, part in docs:
        parts[part or ""].append(([*mask_plain(text or ""), doc is not None and doc > least[text or ""]], doc in good, doc in toxic))
    out, shapley = {}, defaultdict(int)
    for part, rows in parts.items():
        for order in permutations("ABCDE"):
            left = rows
            for step, letter in enumerate(order, 1):
                at = ord(letter) - 65
                gone = [r for r in left if r[0][at]]
                left = [r for r in left if not r[0][at]]
                out[part, "".join(order), step] = (len(left), len(gone), sum(r[0][at] for r in rows) - len(gone), sum(r[0][at] and sum(r[0]) == 1 for r in rows), sum(r[1] for r in gone), sum(r[2] for r in gone))
                shapley[part, letter] += len(gone)
    return {(part, order, step, *x, shapley[part, order[step - 1]]) for (part, order, step), x in out.items()}


def test_filter_audit(spark, odd, no_rows):
    rows = [(d, t, "s" if k % 3 else None if k % 2 else "") for k, (d, t, *_) in enumerate(odd_rows())]
    rows += [(None, "no id", "s"), (None, "no id", "s"), (300, "A B", "s"), (301, "A B", "t"), (301, "A B", "t"), (302, "A B", None), (303, " ".join(f"w{k}" for k in range(250)), "t")]
    labels = [(5, 1, 0), (6, 1, 1), (6, None, 0), (None, 1, 1), (301, 1, None), (302, None, 1), (303, 1, 1), (9, 1, 0), (11, 0, 1)]
    docs = spark.createDataFrame([(*r, 1, 2, "x") for r in rows], "doc_id long, text string, source string, mask int, docs int, hash string").repartition(3)
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    shared = Shared(spark)
    got = op13_filter_audit.audit(op13_filter_audit.mask_counts(op13_filter_audit.ledger(docs, said, shared))).collect()
    assert len(got) == 600 * 3 and {tuple(r) for r in got} == audit_plain(rows, labels)
    assert op13_filter_audit.audit(op13_filter_audit.mask_counts(op13_filter_audit.ledger(no_rows.withColumn("source", F.lit("a")), said.limit(0), shared))).count() == 0
    shared.drop()


def mix_plain(docs):
    """Targets by sharing the excess again and again; documents by sorting."""
    sizes = defaultdict(int)
    for _, text, source in docs:
        sizes[source] += len(WORD.findall(text or ""))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + k % 3 for k, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        room, heavy = total - sum(3 * sizes[s] for s in full), sum(weight[s] for s in order if s not in full)
        more = {s for s in order if s not in full and weight[s] * room / heavy > 3 * sizes[s]}
        if not more:
            break
        full |= more
    targets = {s: float(3 * sizes[s]) if s in full else weight[s] * room / heavy for s in order}
    return sizes, targets


def test_mixing(spark, odd, no_rows):
    rows = [(k, " ".join(["w"] * (1 + k * 7 % 40)), "abcdefg"[k % 7] if k % 11 else None) for k in range(900)]
    rows += [(5000, "same words in a row", "a")] * 700 + [(None, "no id", "b")] * 5 + [(6000 + k, None if k % 2 else " ", "empty") for k in range(4)] + [(7000, "w " * 4000, "h"), (7001, "one", "h"), (7002, "two of", "h")] + [(8000, "x", "tiny")]
    docs = spark.createDataFrame([(*r, 3, 1) for r in rows], "doc_id long, text string, source string, size int, copies int").repartition(5)
    sizes, targets = mix_plain(rows)
    runs = []
    for frame in (docs, docs.repartition(3)):
        shared = Shared(spark)
        got = op11_mixing.mixed(frame, F.struct("doc_id", "text", "source").alias("row"), shared).select("row.*", "size", "source_size", "target", "copies").collect()
        shared.drop()
        runs.append(sorted(map(repr, got)))
        assert len(got) == len(rows)
        taken, longest = defaultdict(int), defaultdict(int)
        for r in got:
            assert r["size"] == len(WORD.findall(r["text"] or "")) and r["source_size"] == sizes[r["source"]] and 0 <= r["copies"] <= 3
            assert r["target"] == pytest.approx(targets[r["source"]])
            taken[r["source"]] += r["copies"] * r["size"]
            longest[r["source"]] = max(longest[r["source"]], r["size"])
        for s, target in targets.items():
            assert abs(taken[s] - target) <= longest[s] / 2
    assert runs[0] == runs[1]
    shared = Shared(spark)
    mixture = op11_mixing.mixture(docs.select("doc_id", "text", "source"), shared)
    assert mixture.columns == ["doc_id", "text", "source", "copy"]
    assert mixture.select(F.sum(F.size(F.expr("filter(split(text, ' '), x -> x != '')")))).first()[0] == sum(taken.values())
    assert op11_mixing.mixed(no_rows, F.col("doc_id"), shared, source_column="lang").count() == 0
    odd_mix = op11_mixing.mixed(odd, F.col("doc_id"), shared).collect()
    assert len(odd_mix) == odd.count()
    shared.drop()


def test_thresholds_take_in_any_weights(spark):
    """Budgets far below, at, and above the sources, with more documents than a level has buckets."""
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.array_repeat(F.lit("w"), (F.col("id") % 9 + 1).cast("int"))).alias("text"), F.when(F.col("id") % 50 == 0, "rare").otherwise("often").alias("source"))
    shared = Shared(spark)
    made = op11_mixing.mixed(rows, F.col("doc_id"), shared).groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("taken"), F.first("target").alias("target"), F.sum("size").alias("size"))
    for r in made.collect():
        assert abs(r["taken"] - r["target"]) <= 4.5
    shared.drop()
