from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.helpers import SF, needs_tables, prose
from vacantia.llm import source_mix
from vacantia.llm.common import cut_lineage, table, work_dir

NAMES = ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]


@needs_tables
def test_each_stage_works_on_what_the_last_one_kept(spark):
    docs = table(spark, SF, "documents")
    assert [name for name, _ in corpus_pipeline.STAGES] == NAMES
    columns, seen = docs.columns, {"documents": docs}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, SF))
        assert docs.columns == columns
        seen[name] = docs
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert ids["documents"] > ids["quality"] > ids["near_duplicates"] >= ids["decontamination"] >= ids["mixing"]
    assert seen["near_duplicates"].count() == len(ids["near_duplicates"])
    copies = source_mix.mix(seen["decontamination"]).where("copies > 0").collect()
    assert {r["doc_id"]: r["copies"] for r in copies} == {r["doc_id"]: r["count"] for r in docs.groupBy("doc_id").count().collect()}
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    start, expected = 0, []
    for r in docs.orderBy("doc_id").collect():
        own = np.array(library.encode(r["text"], add_special_tokens=False).ids + [1], "<u4")
        expected.append((r["doc_id"], start, len(own), zlib.crc32(own.tobytes())))
        start += len(own)
    got = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert sorted(tuple(r) for r in got.select("doc_id", "start", "n_tokens", "ids_crc32").collect()) == sorted(expected)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, quality_ string, kept_id string, scan string, row_ string, copy_ string, node string, owner_ string, score string"


def written(spark, root, docs, labels, benchmark):
    rows = [(i, t, "en", s, None if t is None else len(t), *["x"] * 8) for i, t, s in docs]
    for name, df in (
        ("documents", spark.createDataFrame(rows, SCHEMA)), ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame(benchmark, "item_id long, text string")),
    ):
        df.coalesce(1).write.parquet(f"{root}/{name}.parquet")
    return root


def test_nulls_ties_repeats_and_clashing_names_from_end_to_end(spark):
    item = " ".join(prose(77, 40))
    good = [(i, " ".join(prose(i, 60)), "ab"[i % 2]) for i in range(60)]
    junk = [(100 + i, "\n".join(" ".join(w.upper() + "!!" for w in prose(100 + i, 12)) for _ in range(3)), "a") for i in range(40)]
    near = (200, " ".join([*good[3][1].split()[:-1], "changed"]), "a")
    odd = [(300, None, "a"), (301, "", None), (302, " \n", "b"), (303, item + " and more", "b"), (None, " ".join(prose(500, 70)), None), (304, "long " * 100_000, "a"), (5, good[5][1], "b")]
    docs = [*good, *junk, near, *odd, good[7], good[7]]
    labels = [(i, 1, 0) for i, _, _ in good] + [(i, 0, 1) for i, _, _ in junk] + [(None, 1, 0), (9999, None, None)]
    root = written(spark, work_dir(spark, "edge"), docs, labels, [(1, item), (2, None), (None, "x")])
    kept = table(spark, root, "documents")
    for _, stage in corpus_pipeline.STAGES[:3]:
        columns, kept = kept.columns, cut_lineage(stage(spark, kept, root))
        assert kept.columns == columns
    ids = sorted((r["doc_id"] for r in kept.where("text rlike '[a-z]'").collect()), key=repr)
    assert ids == sorted([i for i, _, _ in good] + [None, 304], key=repr)
    copies = {r["doc_id"]: r["copies"] for r in source_mix.mix(kept).where("copies > 0").collect()}
    out = [tuple(r) for r in corpus_pipeline.run(spark, root).select("doc_id", "start", "n_tokens", "ids_crc32").collect()]
    assert Counter(r[0] for r in out) == copies and len(copies) > 20
    library, text = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), {i: t for i, t, _ in docs if i not in (304,)}
    start = 0
    for doc_id, at, n, crc in sorted(out, key=lambda r: r[1]):
        assert at == start
        start += n
        if doc_id != 304:
            ids = np.array(library.encode(text[doc_id], add_special_tokens=False).ids + [1], "<u4")
            assert (n, crc) == (len(ids), zlib.crc32(ids.tobytes()))


def test_empty_tables(spark):
    docs = [(1, "some words here", "a"), (2, None, None)]
    root = written(spark, work_dir(spark, "edge"), docs, [], [])
    assert [r["doc_id"] for r in corpus_pipeline.run(spark, root).collect()] == [1]
    assert corpus_pipeline.run(spark, written(spark, work_dir(spark, "edge"), [], [(1, 0, 0)], [(1, "a")])).count() == 0
