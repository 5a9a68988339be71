"""The plans of line dedup: as many scans for long repeated runs as for short ones."""


def test_halving_reads_its_tables_in_one_scan_each(spark):
    from barstrata.llm.line_dedup import line_dedup, maximal_runs, suffix_ranks

    counts = []
    for n in (9, 70):
        block = "\n".join(f"line {k} of a run that is repeated" for k in range(n))
        docs = spark.createDataFrame([(1, block), (2, f"own words\n{block}"), (3, f"{block}\nother words")], "doc_id long, text string")
        ranks = suffix_ranks(docs)[1]
        assert len(ranks) == n.bit_length() and all({r.depth for r in x.collect()} == {1 << j} for j, x in enumerate(ranks))
        runs = maximal_runs(ranks, docs)
        counts.append(runs._jdf.queryExecution().optimizedPlan().toString().count("Relation ["))
        got = {(r.id, r.k, r.length, r.first.id, r.first.k) for r in runs.collect()}
        assert got == {(2, 1, n, 1, 0), (3, 0, n, 1, 0)}
        assert {r.doc_id: r.n_removed for r in line_dedup(docs).collect()} == {1: 0, 2: n, 3: n}
    assert counts == [2, 2]


def test_a_round_is_one_table_with_one_join(spark, monkeypatch):
    from barstrata.llm import line_dedup as module

    plans, write = [], module.materialize

    def told(df, label):
        plans.append((label, df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, label)

    monkeypatch.setattr(module, "materialize", told)
    block = "\n".join(f"line {k} of a run that is repeated" for k in range(21))
    docs = spark.createDataFrame([(1, block), (2, f"own words\n{block}"), (2, f"own words\n{block}"), (3, f"{block}\n{block}")], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.runs) for r in module.line_dedup(docs).collect())
    assert got == [(1, 0, ""), (2, 21, "1+21<1:0"), (2, 21, "1+21<1:0"), (3, 42, "0+21<1:0 21+21<1:0")]
    # Depths 1 to 16 and the round without rows; the depths from 2 on are halved.
    labels = [label for label, _ in plans]
    assert labels == ["lines", *["line-ranks"] * 6, "line-parts", *["line-halves"] * 4, "line-runs", "line-cuts"]
    assert {plan.count("Join") for label, plan in plans if label in ("line-ranks", "line-halves")} == {1}
