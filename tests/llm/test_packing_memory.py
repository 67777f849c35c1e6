"""Finding of round 3: a packing worker's memory is bounded by what it is told, in the pipeline by less than alone."""

import public_tokenizers

from locuskey.llm.packing import CHUNK_BYTES, REMEMBERED, WordIds, pack


def test_bounds_of_memory_change_no_result(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    texts = ["w%d is word number %d, Again!" % (i, i * i) * (1 + i % 40) for i in range(300)] + [None, "", "é " * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = lambda **k: {tuple(r) for r in pack(df, path, **k).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset").collect()}
    assert rows() == rows(remembered=50, chunk_bytes=2000)
    assert WordIds(path, 7).remembered == 7


def test_the_pipeline_gives_a_packing_worker_less():
    import corpus_pipeline

    assert corpus_pipeline.REMEMBERED < REMEMBERED and corpus_pipeline.CHUNK_BYTES < CHUNK_BYTES
