import re

import corpus_pipeline
import public_tokenizers as P
import tiktoken

import __spark_entry__ as entry
from tests.llm import test_decontaminate, test_quality, test_secrets, test_simhash
from tests.llm.helpers import tables
from tidemark.llm import bpe, decontaminate, quality, secrets

SF = "/root/testdata/sf0.001"


def test_stages_against_a_plain_pipeline(spark):
    documents, benchmark = tables("0.001", "documents", "benchmark")
    judged = {r.doc_id: r.kept for r in quality.judge(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    rows = [r for r in documents if judged[r[0]]]
    assert not any(test_quality.plain(r[1])[5] for r in rows)
    group, _ = test_simhash.plain([r[:2] for r in rows])
    rows = [r for k, r in enumerate(rows) if group[k] == k]
    segments = decontaminate.Segments([(i, t.encode()) for i, t in benchmark])

    def leaks(text):
        code, _, _ = decontaminate.folded([text.encode()])
        return any(test_decontaminate.least_edits(c, code) <= b for c, b in zip(segments.code, segments.budget, strict=True))

    rows = [r for r in rows if not leaks(r[1])]
    plain = tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(P.path("byte_bpe_50k.tiktoken")), special_tokens={})

    def masked(text):
        spans = test_secrets.plain_base(text)
        assert [s for s in secrets.find(text.encode()) if s[0] in secrets.BASE_KINDS] == spans
        return secrets.masked(text, spans)

    want = {r[0]: plain.encode_ordinary(masked(r[1])) for r in rows}
    got = {r.doc_id: list(r.ids) for r in corpus_pipeline.run(spark, SF).collect()}
    assert got == want
    assert not any(re.search("[0-9a-f]{16,}", masked(r[1])) for r in rows)


def test_stages_return_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_masking", "token_ids"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("doc_id < 20"), SF).dtypes == docs.dtypes


def test_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {n.split("_")[0] for n in names} >= {f"op{k}" for k in range(1, 11)}
