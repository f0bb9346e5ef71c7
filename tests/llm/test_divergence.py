"""op11 against brute force: odd rows, null columns, long texts by pieces, clashing columns."""

import re
from collections import Counter, defaultdict

from geoloom.llm import divergence

DOCS = "doc_id long, text string, lang string, source string, term string, n long, docs long, cells long"


def slow(rows, least=3, top=200):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(la or "", so or "", [t.translate(lower) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", tx or "")]) for tx, la, so in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = {t for t, n in df.items() if n >= least}
        count = defaultdict(Counter)
        for _, so, ts in own:
            count[so].update(t for t in ts if t in kept)
            count[None].update(t for t in ts if t in kept)
        p = {s: {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept} for s, c in count.items()}
        f = lambda a, b: (a - b) ** 2 // b
        for s in count.keys() - {None}:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in count.keys() - {None, s}]
            terms = [(-f(p[s][t], p[None][t]), t.encode(), t) for t in kept if count[s][t] and p[s][t] > p[None][t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out += [(lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(found)]
    return sorted(out)


def audit(spark, rows, **kw):
    df = spark.createDataFrame([(i, *r, "x", 1, 2, 3) for i, r in enumerate(rows)], DOCS)
    return sorted(tuple(r) for r in divergence.audit(df, **kw).select("lang", "source", "part", "item", "value", "rank").collect())


TEXTS = ["The cat, the DOG and the ÉTÉ été 日本 x\x00y", "the cat dog bird 7up", "cat\ncat dog-dog été", "", None, "?! 12", "Zebra zebra ZEBRA the"]


def test_is_brute_force(spark):
    rows = [(TEXTS[(i * 5 + i // 7) % len(TEXTS)], ["en", "de", None, ""][i % 4], ["a", "b", None, "", "é"][i % 5]) for i in range(60)]
    rows += [("alone words here", "xx", "only"), (None, "yy", "a"), (None, "yy", "b")] + [("the cat", "en", "big")] * 40
    got = audit(spark, rows)
    assert got == slow(rows)
    assert {r[:4] for r in got if r[0] == "yy"} == {("yy", "a", "pair", "b"), ("yy", "b", "pair", "a")}
    assert audit(spark, rows, top=2) == slow(rows, top=2)


def test_no_rows(spark):
    assert audit(spark, []) == [] and audit(spark, [(None, None, None)]) == []


def test_long_texts_are_counted_by_pieces(monkeypatch):
    text = "Ab cd  é\x00" * 50 + "z" * 300 + " tail"
    whole = divergence.term_counts(text)
    monkeypatch.setattr(divergence, "PIECE", 16)
    assert divergence.term_counts(text) == whole == Counter({b"ab": 50, b"cd": 50, "é".encode(): 50, b"z" * 300: 1, b"tail": 1})


def test_dictionaries_are_handed_on(spark, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 2)
    rows = [("a b c d", "en", "s"), ("a b e", "en", "t"), ("a a b", "en", "s")]
    assert audit(spark, rows) == slow(rows)


def test_histograms_hold_every_kept_term(spark):
    docs = spark.createDataFrame([("a b c", "en", "s"), ("a b", "en", "t"), ("a c a", "en", "u"), ("b c d", "en", "u")], "text string, lang string, source string")
    kept, groups = divergence.kept_terms(docs, 2)
    found = {(r.a, r.b, r.c, r.d): r.terms for r in divergence.joint_histograms(kept, groups).collect()}
    assert found == {("s", "t", 1, 1): 2, ("s", "t", 1, 0): 1, ("s", "u", 1, 2): 2, ("s", "u", 1, 1): 1, ("t", "u", 1, 2): 1, ("t", "u", 1, 1): 1, ("t", "u", 0, 2): 1}
