from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from foliant.llm.common import stored
from tests.llm.test_near_dups import brute as groups
from tests.llm.test_secret_scan import brute as secrets

FOLDER = "/root/testdata/sf0.001"


def test_stages(spark):
    """Each stage against a plain version of its decision on its own input."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept.append(stored(stage(spark, kept[-1], FOLDER), name.replace(" ", "-")))
        assert kept[-1].columns == columns and kept[-1].dtypes == docs.dtypes
    raw, good, single, masked = ({r.doc_id: r.text for r in df.collect()} for df in kept)
    assert good.items() <= raw.items() and 0 < len(good) < len(raw)
    assert single == {i: good[i] for i, _, _, first in groups(list(good.items())) if first}
    assert masked.keys() == single.keys()
    for i, text in masked.items():
        assert not secrets(text) and (text == single[i] or "[SECRET]" in text)
    by_doc, by_sequence = defaultdict(list), defaultdict(int)
    for r in corpus_pipeline.STAGES[-1][1](spark, kept[-1], FOLDER).collect():
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id] += r.length
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    for i, text in masked.items():
        ids = b"".join(r.ids for r in sorted(by_doc[i], key=lambda r: r.start))
        assert ids == b"".join(x.to_bytes(4, "little") for x in [*tokenizer.encode(text, add_special_tokens=False).ids, 1])
    assert by_doc.keys() == masked.keys() and max(by_sequence.values()) <= 2048
