"""op8's bands: texts at the bound meet, texts that share only their front do not, and entries move once."""

import random

from pyspark.sql import functions as F

from geoloom.llm import edits


def _texts(front: int, many: int):
    rng = random.Random(front)
    base = "".join(rng.choice("abcdefghij klmnop") for _ in range(front))
    return [base + "".join(rng.choice("abcdefghij klmnop") for _ in range(1200 - front)) for _ in range(many)]


def test_a_common_front_makes_few_candidates():
    for front, most in ((0, 5), (300, 60)):
        own = [set(edits.bands(edits.fingerprint(t))) for t in _texts(front, 60)]
        assert sum(bool(a & b) for i, a in enumerate(own) for b in own[:i]) < most  # of 1,770 pairs


def test_texts_at_the_bound_meet_whatever_their_length():
    rng, met, many = random.Random(4), 0, 0
    for n in (30, 60, 63, 65, 120, 127, 129, 160, 250, 260, 510, 520, 1000, 1030, 4090, 4100, 9000):
        for _ in range(12):
            base = [rng.choice("abcdefgh ijklmnop") for _ in range(n)]
            own = list(base)
            for _ in range(rng.randrange(1, 5)):
                own[rng.randrange(n)] = rng.choice(["", "X", "yz"])
            own += [rng.choice("abc") for _ in range(rng.randrange(n // 8))]
            a, b = edits.fingerprint("".join(base)), edits.fingerprint("".join(own))
            if edits.likeness(a, b) >= edits.LIKE:
                many += 1
                met += bool(set(edits.bands(a)) & set(edits.bands(b)))
    assert many > 60 and met / many >= 0.97


def test_bands_are_worked_out_once(spark, monkeypatch):
    prints = spark.createDataFrame([(edits.fingerprint(t),) for t in _texts(1100, 20)], "fingerprint string").withColumn("k", F.xxhash64("fingerprint"))
    plans, keep = {}, edits.cut

    def noted(df, name):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return keep(df, name)

    monkeypatch.setattr(edits, "cut", noted)
    assert edits.links(prints, tile=4).count() > 0
    assert plans["edit-bands"].count("MapInArrow") == 1
