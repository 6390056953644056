"""Every stage of the corpus pipeline against a plain Python version, row by row."""

import re
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest

from spanloom.llm import toxicity
from spanloom.llm.common import materialize, table
from tests.llm.test_layout import check_packing, plain_best_fit, waterfill
from tests.llm.test_native import measures
from tests.llm.test_ngram import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture
def corpus(spark, odd_docs):
    """The smallest documents, odd rows, and copies with a word changed or a tail added."""
    docs = table(spark, SF, "documents")
    rows = [tuple(r) for r in docs.collect()]
    more = []
    for r in rows[::7]:
        w = (r[1] or "").split(" ")
        more.append((900_000 + r[0], " ".join([*w[: len(w) // 2], "changed", *w[len(w) // 2 + 1 :]]), *r[2:]))
        more.append((800_000 + r[0], (r[1] or "") + " and a tail", *r[2:]))
    odd = odd_docs.select(*docs.columns)
    return docs.unionByName(spark.createDataFrame(more, docs.schema)).unionByName(odd)


def rejected(text):
    n, chars, symbols, dup, repeats = measures(text)
    lines = [x for x in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    upper = len(re.findall("[A-Z]", text or ""))
    return (
        n < 50 or 100 * repeats > 50 * n or 10 * symbols > 2 * n or 10 * dup > 3 * len(lines)
        or chars > 14 * n or chars < 2 * n or 2 * upper > chars
    )


def p_toxic(model, text):
    """Of one text: every vocabulary entry is counted by itself."""
    found = re.findall(rb"[a-z0-9\x80-\xff]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    size, total = len(model.vocabulary), 0.0
    for entry, i in model.vocabulary.items():
        if entry[:1] == b"^":
            hits = sum(w.startswith(entry[1:]) for w in found)
        else:
            hits = found.count(entry)
        if hits:
            total += model.weights[i] * np.log1p(hits) + model.weights[size + i] * np.log1p(100.0 * hits / len(found))
    return 1 / (1 + np.exp(model.thresholds[0] - total))


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


def test_stages_equal_plain_versions(spark, corpus):
    stages = dict(corpus_pipeline.STAGES)
    docs = corpus.select(*corpus_pipeline.COLUMNS)

    kept = materialize(stages["quality rules"](spark, docs, SF), "t")
    assert rows_of(kept) == Counter({r: n for r, n in rows_of(docs).items() if not rejected(r[1])})

    model = toxicity.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    clean = materialize(stages["toxicity"](spark, kept, SF), "t")
    assert 0 < clean.count() < kept.count() < docs.count()
    assert rows_of(clean) == Counter({r: n for r, n in rows_of(kept).items() if p_toxic(model, r[1]) < 0.5})

    single = materialize(stages["near duplicates"](spark, clean, SF), "t")
    pairs = [(r.doc_id, r.text) for r in clean.collect()]
    heads = {(c if c is not None else d) for d, _, c in brute(pairs, 5, 80)}
    assert len(heads) < len(pairs) and sorted(r.doc_id for r in single.collect()) == sorted(heads)
    assert not rows_of(single) - rows_of(clean)

    mixed = materialize(stages["mixing"](spark, single, SF), "t")
    before, after = rows_of(single), rows_of(mixed)
    assert set(after) <= set(before) and all(n <= 2 * before[r] for r, n in after.items())
    size, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r, n in before.items():
        words = measures(r[1])[0]
        size[r[3]] += n * words
        taken[r[3]] += after[r] * words
        largest[r[3]] = max(largest[r[3]], words)
    for source, want in waterfill(size).items():
        assert abs(taken[source] - want) <= largest[source]

    packed = stages["packing"](spark, mixed, SF).collect()
    used, _ = check_packing(mixed, packed, 1024)
    assert used <= plain_best_fit([r.length for r in packed], 1024)
