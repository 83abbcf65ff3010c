import hashlib

from pyspark.sql import functions as F

from ledgerloom.llm.exactdedup import drop_exact_copies, exact_groups

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def expected(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault((text or "").translate(ASCII), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        out += [(i, keep, len(ids), hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    return sorted(out, key=str)


def test_groups_match_brute_force_at_any_block_size(spark):
    long = "word Élan " * 40
    rows = [(1, "Aa"), (2, "aA"), (3, None), (4, ""), (5, long), (6, long.upper().replace("É", "é")), (7, long + "x"), (8, long[:-1]),
            (9, "abab"), (10, "ab"), (11, "abababab"), (12, "É"), (13, "é"), (None, "aa"), (14, long), (9, "abab"), (15, "cdab"), (16, "abcd")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for size in (2, 3, 64, 4096):
        got = [(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in exact_groups(df, size).collect()]
        assert sorted(got, key=str) == expected(rows)


def test_one_row_of_each_group_stays_and_columns_do_too(spark):
    rows = [(1, "a", "x"), (2, "A", "y"), (2, "A", "y"), (3, "b", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").withColumn("kept", F.lit(0))
    out = drop_exact_copies(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in out.collect()) == [(2, "A"), (3, "b")]
    assert drop_exact_copies(df.where("false")).count() == 0
