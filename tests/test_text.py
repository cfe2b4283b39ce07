from __future__ import annotations

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom import __main__ as cli
from ledgerloom import streaming
from ledgerloom.functions import text as T
from ledgerloom.operators import chunking, inference, reporting, retrieval, tokenizing
from ledgerloom.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first().y


def test_answers(spark):
    assert one(spark, "The $1,234.5 (A)", T.normalize_answer) == "1234.5"
    assert one(spark, "3 months of 2024-2025, 10 kittens, 5 billion", T.numeric_values) == [3e6, 2024.0, -2025.0, 1e4, 5e9]
    assert one(spark, "in 2025 sales were $109,158 million in 3 months", T.numeric_candidates) == ["202", "5", "$109,158 million", "3 m"]
    assert one(spark, "can't determine", T.is_refusal) is False and one(spark, "cannot determine", T.is_refusal) is True
    assert abs(one(spark, "the net sales", lambda c: T.token_f1(c, F.array(F.lit("net sales rose")))) - 0.8) < 1e-9
    assert one(spark, "5", lambda c: T.numeric_match(T.numeric_values(c), T.numeric_values(F.lit("6")))) is True


def test_sections(spark):
    text = "x\nItem 7.\nManagement's D\nitem 1a. Risk\nSee Item 8 here\nItem 9 " + "z" * 120
    got = one(spark, text, T.sections)
    assert [s.section_id for s in got] == ["Front Matter", "Item 7", "Item 1A"]
    assert [s.section_id for s in one(spark, "no heading", T.sections)] == ["Unknown"]


def test_file_names(spark):
    read = lambda p: tuple(one(spark, p, T.filename_metadata))
    assert read("AAPL_Apple_2025_10K.html") == ("AAPL", "Apple", "2025")


def test_windows(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(300))), (2, ""), (3, None)], "id int, text string")
    assert [(r.chunk_index, r.token_count) for r in chunking.fixed_windows(docs, "id", "text", "fixed_128", 128, 32).orderBy("chunk_index").collect()] == [(0, 128), (1, 128), (2, 108)]
    with pytest.raises(ValueError):
        chunking.fixed_windows(docs, "id", "text", "x", 10, 10)


def pack(units, size, overlap):
    """Packing, told plainly."""
    n = lambda us: sum(len(u.split()) for u in us)
    done, cur = [], []
    for u in units:
        if cur and n(cur) + len(u.split()) > size:
            done.append(" ".join(cur))
            tail = []
            for v in reversed(cur):
                if tail and n(tail) + len(v.split()) > overlap:
                    break
                tail.insert(0, v)
            cur = tail
        cur = [*cur, u]
    return done + ([" ".join(cur)] if cur else [])


def test_packing(spark):
    import random

    r = random.Random(4)
    cases = [[" ".join(["w"] * r.randint(1, 12)) for _ in range(r.randint(0, 15))] for _ in range(60)]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, u array<string>")
    for row in df.select("i", chunking.packed(F.col("u"), 20, 6).alias("p")).collect():
        assert row.p == pack(cases[row.i], 20, 6)


def test_figures():
    assert [chunking.financial_value(*x) for x in [("109,158", "dollars in millions"), ("14 %", ""), ("(5)", "dollars in millions"), ("n/a", "percent"), ("7", "")]] == ["$109.158 billion ($109,158 million)", "14%", "$-5 million", "n/a", "7"]


def test_context_budget(spark):
    rows = [(1, 1, " ".join(["a"] * 10), None, None, None, None), (1, 2, " ".join(["b"] * 8), None, None, None, None), (1, 3, "c", None, None, None, None)]
    df = spark.createDataFrame(rows, "q int, rank int, text string, ticker string, year string, section_id string, source_type string")
    asked = spark.createDataFrame([(1,), (2,)], "q int")
    pieces = lambda budget: {r.q: (r.pieces, r.context == "") for r in retrieval.packed_context(df, asked, "q", budget).collect()}
    assert pieces(20) == {1: (1, False), 2: (0, True)} and pieces(21)[1][0] == 2 and pieces(0)[1][0] == 3


def test_zero_fill(spark):
    docs = spark.createDataFrame([(i, "A", "2024") for i in range(5)], "chunk_key int, ticker string, year string")
    q = spark.createDataFrame([(1, "a", None), (2, "B", "2024")], "pos int, ticker string, year string")
    ranked = spark.createDataFrame([(1, 3, 0.5, 1)], "pos int, chunk_key int, score double, rank int")
    got = sorted((r.pos, r.rank, r.chunk_key, r.score) for r in retrieval.filled(ranked, q, docs, "pos", "chunk_key", 3, ["ticker", "year"]).collect())
    assert got == [(1, 1, 3, 0.5), (1, 2, 0, 0.0), (1, 3, 1, 0.0)]


def test_models(spark):
    enc = lambda s: [ord(c) % 50 for c in s]
    m = inference.Transformer.random(50, 16, 4, 2, 24, encode=enc, decode=lambda ids: "".join(chr(97 + i % 26) for i in ids), stop=None, most_new=5)
    assert len(m.generate("a prompt that is longer than the room there is")) == 5
    a, b = m.logits(enc("abcd")), m.logits(enc("abce"))
    assert abs(a[:3] - b[:3]).max() < 1e-12  # the future isn't seen
    assert 3 < m.loss("abc", "de") < 5 and m.loss("x", "") == 0.0
    df = spark.createDataFrame([("q1", "Question: What did net sales do?\nAnswer:"), ("q2", None)], "id string, prompt string")
    got = [r.generated for r in inference.run_model(df, inference.demo_model, "prompt").orderBy("id").collect()]
    assert got == [inference.demo_model().generate(p) for p in ("Question: What did net sales do?\nAnswer:", "")]  # drawn, but alike every time


def test_checkpoints(tmp_path):
    kw = dict(encode=lambda t: [ord(c) % 50 for c in t], decode=lambda ids: ",".join(map(str, ids)), most_new=6)
    m = inference.Transformer.random(50, 16, 4, 2, 24, **kw)
    m.save(str(tmp_path / "m.npz"))
    back = inference.Transformer.load(str(tmp_path / "m.npz"), **kw)
    assert (back.heads, back.blocks, back.room) == (4, 2, 24) and back.generate("abc") == m.generate("abc")
    assert inference.shape_of(back.w) == {"vocabulary": 50, "width": 16, "blocks": 2, "room": 24}
    with pytest.raises(ValueError):
        inference.shape_of({"words": back.w["words"]})
    with pytest.raises(ValueError):
        inference.Transformer.load(str(tmp_path / "m.npz"), heads=3, **kw)
    hot = inference.Transformer(back.w, 4, temperature=2.0, top_k=3, **kw)
    rng = np.random.default_rng(0)
    z = np.arange(10.0)
    assert {hot._pick(z, rng) for _ in range(200)} == {7, 8, 9} and m._pick(z, rng) == 9


def test_extraction_only(spark):
    df = spark.createDataFrame([("a b c", "5 million"), ("a", None)], "p string, x string")
    assert [(r.generated, r.prompt_tokens, r.completion_tokens) for r in inference.extraction_only(df, "p", "x").collect()] == [("5 million", 3, 2), ("", 1, 0)]


def test_sources(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"x": 1}\n\n{"x": 2}\n')
    assert sorted(r.x for r in files.read_jsonl(spark, str(tmp_path / "a.jsonl"), "x int").collect()) == [1, 2]
    assert files.read_jsonl(spark, str(tmp_path / "none.jsonl"), "x int").count() == 0 and files.count_jsonl(spark, str(tmp_path / "a.jsonl")) == 2
    (tmp_path / "bad.jsonl").write_text('{"x": 1}\n{"x": \n')
    with pytest.raises(Exception):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "x int").collect()
    (tmp_path / "d").mkdir()
    (tmp_path / "d/AAPL_Apple_2025_10K.html").write_text("<html><script>no</script><body><p>Net&nbsp;sales</p> rose</body></html>")
    (tmp_path / "d/empty.txt").write_text("  ")
    docs = files.load_documents(spark, str(tmp_path / "d")).collect()
    assert [(d.ticker, d.year, "no" in d.text, "Net sales" in d.text) for d in docs] == [("AAPL", "2025", False, True)]
    assert files.find_files(spark, str(tmp_path / "nowhere")).count() == 0
    u = files.union_columns([spark.createDataFrame([(1,)], "a int"), spark.createDataFrame([(2,)], "b int")])
    assert u.columns == ["a", "b"]
    files.write_json(str(tmp_path / "j.json"), {"k": [1]})
    assert files.read_json(str(tmp_path / "j.json")) == json.loads('{"k": [1]}') and files.read_json(str(tmp_path / "no.json"), 3) == 3
    (tmp_path / "questions.jsonl").write_text("")
    assert files.question_file(str(tmp_path))[1] == "questions" and files.question_file(str(tmp_path / "d")) == (None, "sample")
    built = [0]

    def build():
        built[0] += 1
        return spark.createDataFrame([(1,)], "a int")

    assert files.cached_chunks(spark, str(tmp_path), "fixed_128", build).count() == files.cached_chunks(spark, str(tmp_path), "fixed_128", build).count() == 1 and built[0] == 1


def test_questions_and_runs(spark, tmp_path):
    path = str(tmp_path / "q.jsonl")
    assert files.load_questions(spark, path).count() == 2 and files.path_exists(spark, path)  # sample ones, written there
    assert files.load_questions(spark, path).count() == 2
    told = files.install_questions(spark, path, str(tmp_path / "out"))
    assert told["questions"] == 2 and told["question_type"] == {"negative": 1, "text_fact": 1} and files.path_exists(spark, str(tmp_path / "out/question_distribution.csv"))
    assert files.install_questions(spark, path, str(tmp_path / "dry"), dry_run=True)["questions"] == 2 and not files.path_exists(spark, str(tmp_path / "dry"))
    with pytest.raises(FileNotFoundError):
        files.install_questions(spark, str(tmp_path / "none"), str(tmp_path / "out"))
    c = files.RunConfig("q", "c", systems=" oracle_gpt, ", limit=1)
    assert c.system_list() == ["oracle_gpt"] and files.RunConfig("q", "c").system_list() == list(files.ALL_SYSTEMS)
    assert [r.question_id for r in c.limited(files.load_questions(spark, path), "question_id").collect()] == ["SAMPLE_1"]
    with pytest.raises(ValueError):
        files.RunConfig("q", "c", systems="x").system_list()
    (tmp_path / "bad.jsonl").write_text('{"x": 1}\n\n{"x": \n')
    assert [r.line for r in files.malformed_lines(spark, str(tmp_path / "bad.jsonl"), "x int").collect()] == ['{"x": ']
    chunks = chunking.build_chunks(files.smoke_documents(spark).withColumn("id", F.monotonically_increasing_id()), "id")
    assert {r.ticker for r in chunks.collect()} == {"KORD", "VELM"}


def test_streams(spark, tmp_path):
    rows = [(i, f"2024-01-01 00:{i:02d}:00", "a", 1.0) for i in range(50)]
    spark.createDataFrame(rows, "id int, ts string, k string, v double").withColumn("ts", F.to_timestamp("ts")).write.parquet(str(tmp_path / "in"))
    like = spark.read.parquet(str(tmp_path / "in"))
    stream = lambda: streaming.windowed(streaming.file_stream(spark, str(tmp_path / "in"), "*.parquet", like), "ts", ["k"], "v", "10 minutes", "5 minutes")
    whole = sorted((str(r.window_start), r.events) for r in streaming.drain(stream(), "whole", "complete").collect())
    assert [n for _, n in whole] == [10] * 5
    done = sorted((str(r.window_start), r.events) for r in streaming.drain(stream(), "done").collect())
    assert done == whole[: len(done)] and len(done) < 5  # only windows that the watermark has passed


def test_reports(spark, tmp_path):
    df = spark.createDataFrame([("a|b", 0.5, None)], "name string, x double, y int")
    assert reporting.markdown_table(df) == "| name | x | y |\n|---|---|---|\n| a\\|b | 0.5000 |  |"
    assert reporting.markdown_table(df.where("false")) == "_No rows._"
    assert "## T" in reporting.report("R", {"T": df, "N": "note"}, str(tmp_path / "r.md"))


def test_inline_rows(spark):
    text = "Revenue by kind, 2023 and then 2025 2024 2023: Total net sales $ 5.0 3 % 4.0 — % 3.0, Services (1) 7 8 9 and Wearables, Home and Accessories 1,000 900 800"
    df = spark.createDataFrame([(1, text, "2020"), (2, "Mac 1 2 3", "2020"), (3, "Mac 1 2 3 in 1999", None), (4, None, None), (5, "Mac 1 2 3", None)], "id int, text string, year string")
    got = {(r.id, r.row_label): (r["values"], r.table_title, r.years) for r in chunking.inline_rows(df, "id", "text", F.col("year")).collect()}
    assert got[1, "Total net sales"] == (["5.0", "4.0", "3.0"], "Revenue", ["2025", "2024", "2023"]) and got[1, "Wearables, Home and Accessories"][0] == ["1,000", "900", "800"] and (1, "Services") in got
    assert got[2, "Mac"][2] == ["2020", "2019", "2018"] and got[3, "Mac"][2] == ["1999"] and got[5, "Mac"] == (["1", "2", "3"], "Financial table", list(chunking.NO_YEARS)) and all(i != 4 for i, _ in got)


def test_context_for_documents_without_any(spark):
    told = "Item 7. Discussion\nNet sales increased primarily due to more services in every region of the world last year.\n"
    figures = "Products\n2025 2024\nServices 109,158 96,169\n"
    docs = spark.createDataFrame([(1, told, "a", "A", "A", "2025"), (2, told + figures, "b", "B", "B", "2025"), (3, told + figures + told, "c", "C", "C", "2025")], "id int, text string, source_file string, ticker string, company string, year string")
    count = lambda c: {r.id: r["count"] for r in chunking.build_chunks(docs, "id", c).where("source_type = 'local_context'").groupBy("id").count().collect()}
    assert count("table_aware_clean_context") == {1: 1, 2: 1, 3: 1} and count("table_aware_mixed") == {2: 1, 3: 1}


def test_configs():
    assert chunking.parse_configs("fixed_128, section_180") == ["fixed_128", "section_180"] and chunking.parse_configs("") == [chunking.DEFAULT_CONFIG]
    with pytest.raises(ValueError):
        chunking.parse_configs("nope")


def test_build_chunks(spark):
    page = "Item 7. Discussion\n(dollars in millions)\nProducts and Services Performance\n2025 2024\nServices 109,158 96,169\nTotal net sales 416,161 391,035\nNet sales increased primarily due to services in every region of the world last year.\n\nItem 8. Statements\nServices 5 6 7 8"
    docs = spark.createDataFrame([(1, page, "AAPL_Apple_2025_10K.html", "AAPL", "Apple", "2025"), (2, None, None, None, None, None), (3, "", "x", None, None, None)], "id int, text string, source_file string, ticker string, company string, year string")
    got = chunking.build_chunks(docs, "id").orderBy("id", "chunk_index").collect()
    assert [(r.section_id, r.source_type) for r in got if r.id == 1][:4] == [("Item 7", "table_row"), ("Item 7", "table_row"), ("Item 7", "table_summary"), ("Item 7", "local_context")]
    assert got[0].text == "Apple (AAPL) fiscal 2025 Products and Services Performance table. Services net sales were $109.158 billion ($109,158 million) in 2025, and $96.169 billion ($96,169 million) in 2024 (dollars in millions)."
    assert got[0].chunk_id.endswith("_table_row_0000_table_aware_mixed") and got[0].retrievable is True
    for c in chunking.CONFIGS:
        assert chunking.build_chunks(docs, "id", c).where("text = ''").count() == 0


def test_tokens_and_back(spark):
    df = spark.createDataFrame([("Net sales rose 4 %.",), ("",), (None,), ("über <|endoftext|> \n x" * 500,)], "t string")
    got = df.select("t", tokenizing.encoded(F.col("t")).alias("ids")).select("t", "ids", tokenizing.decoded(F.col("ids")).alias("back")).collect()
    assert all(r.t == r.back for r in got) and got[1].ids == [] and got[2].ids is None and len(got[0].ids) > 3


def test_commands(spark, data, tmp_path, capsys):
    cli.main(["corpus", str(tmp_path / "c"), "--configs", "fixed_128"], spark)
    cli.main(["inspect", str(tmp_path / "c/chunk_config=fixed_128"), "cranes", "--top-k", "1"], spark)
    assert "Velmotis rents out cranes" in capsys.readouterr().out
    cli.main(["validate", f"{data}/questions_verified.parquet", f"{data}/chunks.parquet", str(tmp_path / "v")], spark)
    assert spark.read.json(str(tmp_path / "v")).count() == 30
    cli.main(["report", f"{data}/evaluation_details.parquet", f"{data}/questions_verified.parquet", "--out", str(tmp_path / "r.md")], spark)
    assert "# Evaluation" in (tmp_path / "r.md").read_text() and "System with the right context" in capsys.readouterr().out
    inference.demo_model().save(str(tmp_path / "m.npz"))
    cli.main(["checkpoint", str(tmp_path / "m.npz")])
    assert "'width': 16" in capsys.readouterr().out
