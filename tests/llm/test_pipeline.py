import re
import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from strandline.llm import pii
from test_lines_quality import brute_measures
from test_simhash import brute_near


MATCHES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def test_stages_match_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want = [r.asDict() for r in docs.collect()]
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf).cache()
        got = now.collect()
        if name == "quality_rules":
            keep = []
            for r in want:
                n, chars, symbols, dup, repeat = brute_measures(r["text"])
                t = r["text"] or ""
                lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in t.split("\n"))
                upper, letters = len(re.findall("[A-Z]", t)), len(re.findall("[A-Za-z]", t))
                bad = n < 20 or 100 * repeat > 30 * n or (symbols >= 10 and 10 * symbols > 2 * n) or (dup >= 3 and 10 * dup > 5 * lines)
                bad = bad or chars < 2 * n or chars > 20 * n or (letters >= 50 and 10 * upper > 6 * letters)
                keep += [r] * (not bad)
            want = keep
        elif name == "exact_dedup":
            groups = {}
            for r in want:
                groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
            want = [min(g, key=lambda r: (-len(r["text"] or ""), r["doc_id"])) for g in groups.values()]
        elif name == "simhash_near_dedup":
            ids = {r.doc_id for r in got}
            classes = brute_near([(r["doc_id"], r["text"]) for r in want])
            want = [r for r in want if classes[r["doc_id"]] == r["doc_id"]]
            assert len(want) < len(classes)
            texts = [r["text"] for r in want]
        elif name == "pii":
            spans = pii.find_spans([r["text"] for r in want], pii.trained_tagger())
            for r, (_, every) in zip(want, spans):
                r["text"] = pii.redact(r["text"], every)
                r["n_chars"] = len(r["text"])
            assert any(every for _, every in spans)
            for text, (_, every) in zip(texts, spans):  # the contract's own patterns
                for kind, pattern in MATCHES.items():
                    for m in re.finditer(pattern, text):
                        if kind == "email" or 8 <= len(re.sub(r"\D", "", m[0])) <= 15:
                            assert (kind, m.start(), m.end()) in every
        else:
            t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
            t.encode_special_tokens = True
            crc = {}
            for r in want:
                crc[r["doc_id"]] = t.encode(r["text"], add_special_tokens=False).ids + [2]
            for r in got:
                assert r.ids_crc32 == zlib.crc32(np.array(crc[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
            assert sum(r.length for r in got) == sum(map(len, crc.values()))
            continue
        assert sorted(map(str, (r.asDict() for r in got))) == sorted(map(str, want)), name


def test_edge_cases_pass_through(spark, tricky, nothing):
    clashing = tricky.withColumnsRenamed({"id": "k", "fp": "rule_n_words", "h": "row"})
    now = clashing
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, "").cache()
        assert now.columns == clashing.columns, name
    # Of the odd texts only the quality rules' survivors reach the packing; copies of them do not.
    left = [r.text for r in now.collect()]
    assert len(left) == len(set(left)) and None not in left and "" not in left
    packed = corpus_pipeline.STAGES[-1][1](spark, now, "").collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in now.collect()}
    now = nothing
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, "")
        assert now.count() == 0, name


def test_every_stage_takes_odd_rows_by_itself(spark, tricky):
    n = tricky.count()
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, tricky, "").collect()
        if name in ("pii",):
            assert len(got) == n
        elif name == "best_fit_packing":
            assert len({(r.sequence_id, r.offset) for r in got}) == len(got) >= n
        else:
            assert 0 < len(got) < n or name == "quality_rules"
