import re

import __spark_entry__ as entry
import corpus_pipeline


def test_each_operator_has_one_query_and_the_pipeline_its_stages():
    numbers = [int(m[1]) for m in (re.match(r"op(\d+)_", k) for k in entry.queries()) if m]
    assert sorted(numbers) == list(range(1, 14))
    assert entry.queries()["pipeline"] is corpus_pipeline.run
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "byte_bpe"]
