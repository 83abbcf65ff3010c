import random

import corpus_pipeline
from ledgerloom.llm.stages import written


def test_each_stage_on_planted_rows(spark, tmp_path):
    rng = random.Random(5)
    words = [a + b + c for a in ("th", "re", "on", "an", "ti", "lo") for b in ("", "in", "er", "st") for c in ("ed", "ing", "at", "ou")]
    text = lambda n: " ".join(rng.choices(words, k=n))
    rude = lambda n: " ".join(rng.choice(["scoundrel", "nitwitted", "blockhead"]) if i % 15 == 7 else rng.choice(words) for i in range(n))
    passage = text(40)
    docs = [(i, text(rng.choice([60, 150, 400])), "en", f"s{i % 4}", 1) for i in range(240)] + [(1000 + i, rude(150), "en", "s1", 1) for i in range(60)]
    docs += [(2000, docs[3][1].upper(), "en", None, None), (2001, docs[200][1].replace(" ", "  "), "en", "s0", 0), (2002, text(30) + " " + passage + " " + text(30), "en", "s2", 0)]
    docs += [(2003, None, None, None, None), (2004, "", "", "", 0), (2003, None, None, None, None), (None, text(90), "en", "s0", 0)]
    long = text(900)
    docs += [(2010, long, "en", "s3", 0), (2011, long.replace("thed", "xyz", 1), "en", "s3", 0)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i >= 1000)) for i in [*range(240), *range(1000, 1060)]], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    left, now = {}, spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = now.columns
        now = written(stage(spark, now, str(tmp_path)), "test")
        left[name] = sorted((r.doc_id for r in now.select("doc_id").collect()), key=str)
        if name != "mixing":
            assert now.columns == before
    clean = set(range(240))
    assert clean <= set(left["toxicity"]) and len([i for i in left["toxicity"] if i and 1000 <= i < 1060]) <= 3
    assert 3 not in left["exact dedup"] and 2000 in left["exact dedup"] and left["exact dedup"].count(2003) + left["exact dedup"].count(2004) == 1
    near = left["simhash near-dedup"]
    assert 200 in near and 2001 not in near and 2010 in near and 2011 not in near and None in near
    assert (clean - {3}) <= set(near) and 2002 not in left["benchmark decontamination"] and (clean - {3}) <= set(left["benchmark decontamination"])
    assert left["mixing"] == left["benchmark decontamination"]
    assert all(r.taken == r.copies * r.size and r.copies <= 3 for r in now.collect())
