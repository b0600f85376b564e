"""Near texts held against exact counts on many isolated pairs."""

import itertools

from statloom.llm import near_texts


def pairs_of(spark, pairs, both, left, right):
    """Isolated pairs: texts that share `both` five-word shingles and have `left` and `right` more, at their ends."""
    word, found = map("w{}".format, itertools.count()), []
    for _ in range(pairs):
        common = [next(word) for _ in range(both + 4)]
        found += [" ".join(common + [next(word) for _ in range(more)]) for more in (left, right)]
    table = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_texts.near_texts(table).collect()}
    return sum(got[2 * k] == got[2 * k + 1] for k in range(pairs)), len(set(got.values()))


def test_every_pair_at_four_fifths_is_found(spark):
    assert pairs_of(spark, 400, 12, 0, 3) == (400, 400)
    assert pairs_of(spark, 400, 40, 5, 5) == (400, 400)


def test_no_pair_below_four_fifths_is_joined(spark):
    assert pairs_of(spark, 400, 15, 2, 2) == (0, 800)


def test_one_row_for_each_group_whatever_the_ids(spark):
    words = lambda name, n=30: " ".join(f"{name}{k}" for k in range(n))
    rows = [
        (5, words("a")), (5, words("b")), (None, words("c")), (None, words("d")), (None, words("d")), (7, words("e")),
        (7, words("e")), (3, words("g", 60)), (5, words("g", 61)), (None, words("g", 60)),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = near_texts.first_of_groups(docs, near_texts.near_texts(docs)).collect()
    want = [(5, "a0"), (5, "b0"), (None, "c0"), (None, "d0"), (7, "e0"), (3, "g0")]
    assert sorted(((r.doc_id, r.text.split()[0]) for r in got), key=repr) == sorted(want, key=repr)
