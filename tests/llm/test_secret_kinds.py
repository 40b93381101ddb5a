from lumenframe.llm import secret_scan


def test_each_kind_is_a_whole_candidate(spark):
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.dBjftJeZ4CVP-mB92K27uhbUJU1p1r_w"
    kinds = {
        'x password = "hunter2x" y': "hunter2x", "password: 'correct-horse'": "correct-horse", "a pwd=Passw0rd! b": "Passw0rd!",
        'api_key = "abcdefghijklmnopqrst"': "abcdefghijklmnopqrst", '{"access_key": "abcdefgh"}': "abcdefgh", "auth=abcdefgh12==": "abcdefgh12==",
        f"bearer {jwt} z": jwt, "run AbCdEfGhIjKlMnOpQrStUv end": "AbCdEfGhIjKlMnOpQrStUv",
    }
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(kinds)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["start"], r["finding"]) for r in secret_scan.candidates(docs, None).collect())
    assert got == [(k, t.index(f), f) for k, (t, f) in enumerate(kinds.items())]
