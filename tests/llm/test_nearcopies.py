import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.helpers import AWKWARD, documents, prose
from tracewell.llm import nearcopies, simhash
from tracewell.llm.simhash import TAU, majority


def plain_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else {" ".join(words)} - {""}


def plain_kept(rows):
    """The smallest doc_id of each component, pair by pair."""
    sets, top = [plain_set(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and top[i] != top[j]:
                old, new = max(top[i], top[j]), min(top[i], top[j])
                top = [new if t == old else t for t in top]
    least = {}
    for (doc_id, _), t in zip(rows, top):
        least[t] = min(doc_id, least.get(t, doc_id))
    return sorted(least.values())


def copies(seed, per_group):
    """Texts with copies in which some words are replaced, at similarities around 0.8."""
    pick, rows = random.Random(seed), []
    for g in range(12):
        words = prose(g, 150).split()
        for _ in range(per_group):
            changed = list(words)
            for _ in range(pick.randint(0, 5)):
                changed[pick.randrange(len(words))] = f"w{pick.randrange(10**6)}"
            rows.append(" ".join(changed))
    ids = list(range(len(rows)))
    pick.shuffle(ids)
    return list(zip(ids, rows))


def kept(spark, rows):
    return sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect())


@pytest.mark.parametrize("hot", [3, 32])
def test_copies_with_a_few_changed_words_go(spark, monkeypatch, hot):
    monkeypatch.setattr(nearcopies, "HOT", hot)
    rows = copies(hot, 8)
    assert kept(spark, rows) == plain_kept(rows)


def test_awkward_documents(spark):
    rows = [r for r in AWKWARD if r[0] is not None]
    assert kept(spark, rows) == plain_kept([(r[0], r[1]) for r in rows])


def test_a_repeated_doc_id_keeps_its_unlike_text(spark):
    rows = [(1, prose(1, 40)), (5, prose(2, 40)), (5, prose(1, 40)), (5, prose(2, 40)), (None, prose(1, 40))]
    left = corpus_pipeline.near_dedup(spark, documents(spark, rows), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in left) == sorted([(0, rows[4][1]), (1, rows[0][1]), (5, rows[1][1])])


def family(seed, count, least, most):
    """Texts of one template in which ``least`` to ``most`` words are replaced."""
    pick, words, rows = random.Random(seed), prose(seed, 150).split(), []
    for i in range(count):
        changed = list(words)
        for at in pick.sample(range(len(words)), pick.randint(least, most)):
            changed[at] = f"w{seed}x{pick.randrange(10**6)}"
        rows.append((i, " ".join(changed)))
    return rows


def test_a_large_bucket_of_unlike_texts_is_not_compared_pair_by_pair(spark, monkeypatch):
    """150 texts of one template, most of them less alike than the limit: 11,175 pairs."""
    met, verified = [], nearcopies._verified

    def counted(*given):
        met.append(given[-1].count())
        return verified(*given)

    rows = family(7, 150, 5, 9) + [(1000 + i, t) for i, t in family(7, 10, 0, 2)]
    monkeypatch.setattr(nearcopies, "HOT", 8)
    monkeypatch.setattr(nearcopies, "_verified", counted)
    assert kept(spark, rows) == plain_kept(rows)
    assert sum(met) < 10 * len(rows)


def test_fingerprints_link_what_no_band_holds(spark, monkeypatch):
    """Without band keys the links are those of SimHash, each verified."""
    plain = nearcopies.signatures
    monkeypatch.setattr(nearcopies, "signatures", lambda docs: plain(docs).withColumn("keys", F.array().cast("array<long>")))
    words = prose(3, 900).split()
    rows = [(1, " ".join(words)), (2, " ".join([*words[:-1], "other"])), (3, prose(4, 300))]
    apart = [int(majority([nearcopies.shingle_set(t.encode())])[0]) for _, t in rows]
    assert (apart[0] ^ apart[1]).bit_count() <= TAU < (apart[0] ^ apart[2]).bit_count()
    assert kept(spark, rows) == [1, 3]


def test_bits_of_a_long_text_are_counted_in_blocks(monkeypatch):
    hashes = [nearcopies.shingle_set(prose(i, 200).encode()) for i in range(3)]
    whole = majority(hashes)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    assert majority(hashes).tolist() == whole.tolist()
