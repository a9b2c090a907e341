import random
import re

from tests.llm.helpers import AWKWARD, documents
from tracewell.llm import pii

# The contract's patterns, as worded.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_base(text):
    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in CARD.finditer(text):
        digits = re.sub(r"\D", "", m.group())
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, digits[::-1])))
        if 16 <= len(digits) <= 19 and total % 10 == 0:
            out.append(("card", *m.span()))
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= len(re.sub(r"\D", "", m.group())) <= 15]


def with_check_digit(digits):
    return next(digits + str(d) for d in range(10) if pii.luhn(digits + str(d)))


def planted(seed, n=400):
    pick = random.Random(seed)
    number = lambda k: "".join(pick.choice("0123456789") for _ in range(k))
    kinds = [
        lambda: f"{pick.choice('abc')}x.{number(2)}@mail{number(1)}.example.com",
        lambda: ".".join(str(pick.randint(0, 255)) for _ in range(4)),
        lambda: with_check_digit(number(15)),
        lambda: f"+1 ({number(3)}) 555-{number(4)}",
        lambda: f'token = "{"".join(pick.choice("0123456789abcdef") for _ in range(40))}"',
        lambda: number(pick.randint(1, 18)),
        lambda: f"version {pick.randint(1, 9)}.{pick.randint(0, 9)}",
    ]
    return [f"some words before {pick.choice(kinds)()} and after, {pick.choice(kinds)()}." for _ in range(n)]


def test_base_spans_equal_the_patterns():
    pick = random.Random(0)
    for _ in range(4000):
        text = "".join(pick.choice("01259ab@@..+-- ()_%é\n") for _ in range(pick.randint(0, 60)))
        assert pii.base_spans(text) == plain_base(text), text
    for text in planted(1):
        assert pii.base_spans(text) == plain_base(text)


def test_long_runs_take_linear_time():
    for unit in ("a", "1", "@", "a@", "1.", "+1", "+1 (", "a.", "1 ", "é"):
        pii.spans_of(unit * (300_000 // len(unit)), None)
    pii.spans_of("x" * 300_000 + "@" + "y" * 300_000, None)


def test_segment_sums_equal_enumeration():
    import itertools

    import numpy as np

    scores = np.random.default_rng(3).normal(size=(5, 2))
    segments = [(0, 1), (0, 2), (1, 3), (2, 3), (3, 4)]
    total, want, best = 0.0, np.zeros((5, 2)), (-1.0, [])
    for on in itertools.product([None, 0, 1], repeat=5):
        chosen = [(k, c) for k, c in enumerate(on) if c is not None]
        if any(segments[a][0] < segments[b][1] and segments[b][0] < segments[a][1] for (a, _), (b, _) in itertools.combinations(chosen, 2)):
            continue
        value = sum(scores[k, c] for k, c in chosen)
        best = max(best, (value, chosen))
        total += np.exp(value)
        for k, c in chosen:
            want[k, c] += np.exp(value)
    assert np.allclose(pii.segment_marginals(4, segments, scores), want / total)
    assert pii.best_segments(4, segments, scores) == best[1]


def test_field_finds_planted_values_and_keeps_base_spans():
    weights = pii.fit(planted(1))
    secrets = 0
    for text in planted(2):
        base, spans = pii.spans_of(text, weights)
        assert set(base) <= set(spans)
        assert [s for s in spans if s[0] in ("email", "ip", "phone")] == [s for s in base if s[0] in ("email", "ip", "phone")]
        values = {m.group(1) for m in re.finditer(r'token = "(\w+)"', text) if not any(a < m.end(1) and m.start(1) < b for _, a, b in base)}
        secrets += len(values)
        assert values == {text[s:e] for k, s, e in spans if k == "secret"}
    assert secrets > 50
    double = with_check_digit("4" * 15)
    assert [s[0] for s in pii.spans_of(f"pay {double} {double} now", weights)[1]] == ["card", "card"]


def test_awkward_documents(spark):
    docs = documents(spark, AWKWARD + [(50, "mail a@b.cd now"), (51, "mail a@b.cd now")])
    weights = pii.model(docs)
    out = pii.find(docs.selectExpr("*", "1 pii_base"), weights)
    assert out.count() == docs.count() and out.columns == [*docs.columns, "pii_base", "pii_spans"]
    for r in out.collect():
        assert [tuple(s) for s in r["pii_base"]] == plain_base(r["text"] or "")
    masked = {r["doc_id"]: r for r in pii.find(docs, weights, masked=True).collect()}
    assert masked[50]["text"] == "mail [EMAIL] now" and masked[50]["n_chars"] == 16 and masked[1]["text"] is None


def test_overlapping_spans_are_masked_as_one():
    assert pii.mask("ab12345cd", [("card", 2, 6), ("phone", 4, 7)]) == "ab[CARD]cd"


def test_empty_table_and_texts_without_digits(spark):
    empty = documents(spark, [])
    assert pii.find(empty, pii.model(empty)).collect() == []
    assert pii.model(documents(spark, [(1, "no digit")])) is None
