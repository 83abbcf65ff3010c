from ledgerloom.llm.urlfilter import Rule, flagged_word, judge, prefix_rule


def test_longest_rule_wins_else_flagged_words(spark):
    urls = [
        "https://a.example.org/en/123", "http://example.org/es/x", "http://notexample.org/es/x", "HTTP://ORG/", "x://a.org", "https://A.Com/fr/?q#f", "https://a.com/FR/", "https://m.com/de/9",
        "https://adult-x.example.net/fr/", "https://badult.net/adult/", "https://casino.net", None, "", "no scheme", "a://b://c/d", "http://example.org:80/es/", "http://x.com/fr", "ftp://é.org/ü\n?x", "http://a.example.org/en/123",
    ]
    df = spark.createDataFrame([(i, u, i) for i, u in enumerate(urls)], "page_id long, url string, row int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge(df).collect()}
    want = [
        ("a.example.org", "/en/123", "example.org/en/1", "block"), ("example.org", "/es/x", "example.org/es/", "block"), ("notexample.org", "/es/x", "org/", "allow"), ("org", "/", "org/", "allow"),
        ("a.org", "", None, "allow"), ("a.com", "/fr/", "com/fr/", "allow"), ("a.com", "/FR/", None, "allow"), ("m.com", "/de/9", "com/de/", "block"), ("adult-x.example.net", "/fr/", None, "block"),
        ("badult.net", "/adult/", None, "allow"), ("casino.net", "", None, "block"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("b:", "//c/d", None, "allow"),
        ("example.org:80", "/es/", None, "allow"), ("x.com", "/fr", None, "allow"), ("é.org", "/ü\n", "org/", "allow"), ("a.example.org", "/en/123", "example.org/en/1", "block"),
    ]
    assert [got[i] for i in range(len(urls))] == want
    assert judge(df.where("false")).count() == 0


def test_rules_without_tokens_run_everywhere(spark):
    df = spark.createDataFrame([(1, "http://a.net/~x"), (2, "http://b.net/y"), (2, "http://b.net/y")], "page_id long, url string")
    rules = [Rule("block", "tilde", "~", [], 1), prefix_rule("allow", "net/"), flagged_word("spam")]
    assert sorted((r.page_id, r.rule) for r in judge(df, rules).collect()) == [(1, "net/"), (2, "net/"), (2, "net/")]
    assert sorted((r.page_id, r.rule) for r in judge(df, rules[:1]).collect() if r.rule) == [(1, "tilde")]
