"""The pipeline's stages on a small table: each stage's decisions against the operators' brute-force versions."""

import random

import corpus_pipeline


def test_stages(spark):
    rng = random.Random(2)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    copy = text(80)
    texts = [copy, copy, copy + " extra", "short", "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" " + text(60), None, *[text(rng.randint(20, 90)) for _ in range(30)]]
    docs = spark.createDataFrame([(k, t, "en", f"s{k % 3}", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        seen.append((name, docs.columns, docs.collect()))
    names = ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(c == names for _, c, _ in seen[:4])
    kept = {r.doc_id for r in seen[0][2]}
    assert kept == set(range(36)) - {3, 5}
    once = {r.doc_id for r in seen[1][2]}
    assert 0 in once and 1 not in once and len(once) >= 31
    safe = {r.doc_id: r for r in seen[2][2]}
    assert safe.keys() == once and "04dbebab" not in safe[4].text and safe[4].n_chars == len(safe[4].text)
    assert {r.doc_id for r in seen[3][2]} <= once
    assert sum(r.length for r in seen[4][2]) == sum({(r.doc_id): r.doc_tokens for r in seen[4][2]}[k] * n for k, n in _counts(seen[3][2]).items())


def _counts(rows):
    out = {}
    for r in rows:
        out[r.doc_id] = out.get(r.doc_id, 0) + 1
    return out


def test_mixing_counts_rows_not_ids(spark):
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    data = [(None, words("a", 40), "en", "s0", 1), (None, words("b", 700), "en", "s1", 1), (5, words("c", 50), "en", "s0", 1), (5, words("d", 900), "en", "s2", 1)]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
    takes = corpus_pipeline.mixing.mix(docs)
    want = {(r.source, r.size): r.n for r in takes.select("source", "size", corpus_pipeline.repetitions().alias("n")).collect()}
    got = {}
    for r in corpus_pipeline.mixed(spark, docs, "").collect():
        got[r.source, len(r.text.split())] = got.get((r.source, len(r.text.split())), 0) + 1
    assert got == {k: n for k, n in want.items() if n} and len(set(want.values())) > 1


def test_near_dedup_by_similarity(spark):
    rng = random.Random(3)
    data = []
    for k in range(40):
        words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(200)]
        near, far = list(words), list(words)
        for at in (20, 70, 120, 170)[: 1 + k % 4]:  # five shingles each: similarities of 0.95 to 0.81
            near[at] = "x"
        for at in range(10, 200, 20):  # 0.59
            far[at] = "y"
        data += [(3 * k, " ".join(words)), (3 * k + 1, " ".join(near)), (3 * k + 2, " ".join(far))]
    docs = spark.createDataFrame([(None, "ab cd"), (None, "AB  cd"), (None, "ab ce"), (900, None), (901, " "), *data], "doc_id long, text string")
    got = [tuple(r) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert sorted(r[0] for r in got if r[0] is not None) == sorted([900, *(k for k, _ in data if k % 3 != 1)])
    assert len([r for r in got if r[0] is None]) == 2 and ("ab ce" in {r[1] for r in got})


def test_stages_on_empty_tables_and_clashing_columns(spark):
    """Every stage gives the same rows whatever other columns stand beside, and nothing for nothing."""
    rng = random.Random(8)
    text = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    texts = [None, "", " \n", *[text(40) for _ in range(6)], "password = abcdEFGH1234zz " + text(30)]
    texts += [texts[4], texts[4] + " more"]
    rows = [(k if k != 5 else None, t, [None, "en"][k % 2], [None, "s"][k % 2], None) for k, t in enumerate(texts)] + [(4, texts[4], "en", "s", None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    clash = ["key", "row", "size", "kept", "hash", "ids", "n", "root", "node", "fp", "bucket", "path", "spans", "owned", "rank", "copies"]
    plain = spark.createDataFrame(rows, schema)
    wide = spark.createDataFrame([(*r, *[f"x{k}" for k in range(len(clash))]) for r in rows], schema + "".join(f", {c} string" for c in clash))
    for _, stage in corpus_pipeline.STAGES:
        base, more = stage(spark, plain, ""), stage(spark, wide, "")
        told = lambda df: sorted((tuple(r) for r in df.select("doc_id", *[c for c in ("text", "length") if c in df.columns]).collect()), key=repr)
        assert told(base) == told(more)
        assert more.columns == (wide.columns if "text" in more.columns else base.columns)
        assert stage(spark, plain.where("false"), "").count() == 0


def test_run_stores_each_stage(spark, tmp_path):
    rng = random.Random(5)
    text = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(60))
    rows = [(k, text(), "en", f"s{k % 2}", 1) for k in range(24)]
    rows += [(100, rows[3][1], "en", "s1", 1), (101, "short", "en", "s0", 1), (102, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got} <= set(range(24)) and len({r.doc_id for r in got}) > 10
    used = {}
    for r in got:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in used.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:], strict=False)) and pieces[0][0] == 0
