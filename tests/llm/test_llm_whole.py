"""Whole results where passes, samples or cells used to cut them."""

import numpy as np
import pytest
from vecloom.functions.arrow_vectors import normalise
from vecloom.llm import abuse, clusters


def bridged_groups(count, size=60, bridge=5, dim=64, seed=11):
    """A chain of groups whose centres have a cosine of 0.6 to the next, each pair joined by some vectors between."""
    rng = np.random.default_rng(seed)
    axes = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    centres = [axes[0]]
    for i in range(1, count):
        centres.append(0.6 * centres[-1] + 0.8 * axes[i])
    rows, owner = [], []
    for i, c in enumerate(centres):
        rows.append(c + rng.normal(scale=0.02, size=(size, dim)))
        owner += [i] * size
        if i:
            rows.append(c + centres[i - 1] + rng.normal(scale=0.02, size=(bridge, dim)))
            owner += [-1] * bridge
    return normalise(np.concatenate(rows).astype(np.float32)), np.array(owner)


@pytest.mark.parametrize("local_rows", [6_144, 300])
def test_no_group_of_a_long_chain_is_lost(spark, local_rows):
    rows, owner = bridged_groups(14)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "id bigint, values array<float>")
    got = clusters.similarity_clusters(df, cell_rows=1 << 30, local_rows=local_rows).collect()
    assert len({r.id for r in got}) == len(got) and all(r.similarity >= 0.8 for r in got)
    by = {}
    for r in got:
        by.setdefault(r.typical_id, []).append(r.id)
    unit = rows.astype(np.float64)
    for typical, members in by.items():
        assert typical in members and len(members) >= 10 and {r.size for r in got if r.typical_id == typical} == {len(members)}
        assert unit[typical] @ unit[members].sum(axis=0) >= (unit[members] @ unit[members].sum(axis=0)).max() - 1e-6
    # a vector between two groups may be the most typical of both, so that single ones lie too far from it
    inside = np.isin(np.arange(len(rows)), [r.id for r in got])
    assert all(inside[owner == g].mean() >= 0.95 for g in range(14))


def test_a_component_is_taken_apart_and_leftovers_are_offered():
    rows, owner = bridged_groups(50)
    groups = clusters.peel(np.arange(len(rows)), rows, 0.8, 10, 4)
    got = np.concatenate([own for _, own in groups])
    assert len(set(got.tolist())) == len(got) and set(np.flatnonzero(owner >= 0).tolist()) <= set(got.tolist())
    free = np.setdiff1d(np.arange(len(rows)), got)
    # what is in no group could join none: it is far from every most typical member, or would move it away from members
    for i in free:
        for centre, own in groups:
            wider = np.append(own, i)
            moved = wider[np.argmax(rows[wider].astype(np.float64) @ rows[wider].astype(np.float64).sum(axis=0))]
            assert rows[centre] @ rows[i] < 0.8 + 1e-6 or (rows[wider] @ rows[moved]).min() < 0.8 + 1e-6


def test_share_of_cases_is_counted_over_all_documents(spark, monkeypatch):
    seen = []
    model = abuse.Fitted.model
    monkeypatch.setattr(abuse.Fitted, "model", lambda self, documents, above: seen.append((documents + self.labelled, self.labelled, above)) or model(self, documents, above))
    rows = [(i, "you are a stupid idiot, shut up!" if i % 1_000 == 999 else f"plain words about method {i}") for i in range(6_000)] + [(None, "you idiot"), (9_999, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    abuse.train(docs, spark.createDataFrame([(i, int(i % 1_000 == 999)) for i in range(990, 1_010)], "doc_id bigint, toxic int"))
    assert seen[0][:2] == (6_000, 20) and seen[0][2] <= 20


def test_cut_follows_the_share_of_cases():
    rng = np.random.default_rng(1)
    bad, good = rng.normal(2, 1, 1_000), rng.normal(0, 1, 1_000)
    found = abuse.Fitted([abuse.Model(np.zeros(abuse.BUCKETS, np.float32))], [(bad, np.ones(1_000))], [(good, np.ones(1_000))], 0, 0)
    assert found.model(1_000_000, 50).threshold > found.model(1_000_000, 50_000).threshold > found.model(1_000_000, 200_000).threshold


def test_few_abusive_labels_give_no_quota(spark):
    words = ["model", "proof", "sample", "cohort", "margin", "theorem", "value", "lemma"]
    rng = np.random.default_rng(4)
    plain = lambda: " ".join(rng.choice(words, 40))
    rows = [(i, "s", f"{plain()} you are a stupid idiot, shut up! {plain()}" if i % 10 == 0 else plain()) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string")
    model = abuse.train(docs, spark.createDataFrame([(i, int(i % 10 == 0)) for i in range(60)], "doc_id bigint, toxic int"))
    flagged = {r.doc_id for r in abuse.abuse_scores(docs, model).where("score > 0").collect()}
    assert flagged == {i for i in range(400) if i % 10 == 0}
