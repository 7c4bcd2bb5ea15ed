import random

import numpy as np

from casebook.llm import op09_minhash as m, textblock as tb


def test_members_of_one_bucket_are_joined_as_all_pairs_would(spark):
    draw = random.Random(5)
    bases = [[f"w{draw.randrange(400)}" for _ in range(draw.choice((60, 70, 90)))] for _ in range(8)]
    texts = []
    for k in range(300):
        words = list(draw.choice(bases))
        for _ in range(draw.choice((0, 1, 1, 2, 4))):
            words[draw.randrange(len(words))] = f"x{draw.randrange(900)}"
        texts.append((k, " ".join(words[: draw.choice((len(words), len(words) - 3))])))
    # one class of 100 documents is known before, the others stand alone
    rows = [(1, k, 0 if k < 100 else k) for k, _ in texts]
    idf = spark.sparkContext.broadcast(np.ones(m.BUCKETS, np.float32))
    got = m._crossed(spark.createDataFrame(rows, "bucket bigint, doc_id bigint, class_id bigint"), spark.createDataFrame(texts, "doc_id bigint, text string"), idf, 0.8).collect()
    sets = {k: next(iter(m.shingles(tb.Words([t]), idf.value))) for k, t in texts}

    def classes(links):
        own = {k: c for _, k, c in rows}
        for a, b in links:
            u, v = own[a], own[b]
            if u != v:
                own = {k: min(u, v) if c in (u, v) else c for k, c in own.items()}
        return own

    every = [(a, b) for a in sets for b in sets if a < b and m.jaccard(sets[a], sets[b]) >= 0.8]
    assert all(m.jaccard(sets[r.a], sets[r.b]) >= 0.8 for r in got)
    assert classes([(r.a, r.b) for r in got]) == classes(every)
    assert 1 < len(set(classes(every).values())) < 200
