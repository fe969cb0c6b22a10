"""Golden values of the scalar functions."""

import hashlib
import re
import unicodedata
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lexmill.functions import chunks as C
from lexmill.functions import pii, text
from lexmill.functions.chunks import fixed_chunks, preferred_chunks, recursive_chunks, split_preferred
from lexmill.functions.ids import numbered, signature, uuid5


def one(spark, expr, **values):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()] or [F.lit(1).alias("x")])
    return row.select(expr.alias("r")).first()["r"]


def plainly_redacted(text: str) -> tuple[str, dict[str, int]]:
    """Brute force: the whole text spelled out character by character, every shape tried at every place."""
    spelled = [("" if unicodedata.category(c) == "Cf" else unicodedata.normalize("NFKC", c), i) for i, c in enumerate(text)]
    view, owner = "".join(x for x, _ in spelled), [i for x, i in spelled for _ in x]
    hits = [(owner[m.start()], pii.KINDS.index(kind), owner[m.start()] - owner[m.end() - 1], k, owner[m.end() - 1], re.sub("[ -]", "", m[0]), head, tail, mask) for k, (shape, kind, head, tail, mask) in enumerate(pii.SHAPES) for m in re.finditer(shape, view)]
    out, counts, at = "", dict.fromkeys(pii.KINDS, 0), 0
    for start, kind, _, _, end, digits, head, tail, mask in sorted(hits):
        if start >= at:
            counts[pii.KINDS[kind]] += 1
            out, at = out + text[at:start] + digits[:head] + mask + digits[-tail:], end + 1
    return out + text[at:], counts


def separated_numbers() -> list[str]:
    """A phone and a card number with each character that may stand in one, as separator and as digit, and what is near."""
    near = {p for p in range(0x110000) if unicodedata.category(chr(p)) == "Cf" or (unicodedata.decomposition(chr(p)) and any(x in " -Xx" or x.isdecimal() for x in unicodedata.normalize("NFKC", chr(p))))}
    marks = [chr(p) for p in sorted(near | {32, 45, 88, 0x2010, 0x2011, 0x2013, 0x660, 0x1680, 9, 10})]
    out = [t.format(m) for m in marks for t in ("call 138{0}0013{0}8000.", "6222{0}0212{0}3456{0}7890", "1{0}38001380{0}0", "11010519900101123{0} {0}")]
    return [*out, "⑩" * 9, "1㊿㊿㊿㊿㊿", "x" * 30, "1 " * 40, "-" * 30, "138" + "\u200b" * 50 + "00138000", "13800138000" * 2, "6222021234567890 " * 3]


def test_redaction_lets_nothing_by(spark):
    """The query's values equal brute force whatever stands between the digits; so do those of the documents."""
    texts = separated_numbers()
    assert [pii.redact_text(t)[:2] for t in texts] == [plainly_redacted(t) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pii.redacted(F.col("t")).alias("r"), pii.suspect(F.col("t")).alias("s"))
    for r in docs.collect():
        text, counts = plainly_redacted(texts[r["i"]])
        assert (r["r"]["text"], {k: r["r"][k] for k in pii.KINDS}) == (text, counts), texts[r["i"]]
        assert r["s"] or text == texts[r["i"]]
        assert r["r"]["hidden"] == sum(unicodedata.category(c) == "Cf" for c in texts[r["i"]])


def test_redaction_scans_once(spark):
    """A text that isn't suspect is searched for invisible characters once, in runs, whatever is taken from the result; the classes
    behind wide ranges hold what the alphabet does."""
    docs = spark.createDataFrame([(i, chr(i)) for i in range(0x11000) if not 0xD800 <= i < 0xE000], "i int, c string")
    got = docs.filter(F.col("c").rlike(pii.alphabet().hidden)).select("i")
    assert {r["i"] for r in got.collect()} == {p for p, said in pii.alphabet().plain.items() if said == "" and p < 0x11000}
    plan = docs.select(pii.redacted(F.col("c")).alias("r")).agg(*[F.sum(f"r.{k}") for k in (*pii.KINDS, "hidden")])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
    assert "]+" in pii.redacted(F.col("c"))._jc.toString()


def test_redaction_queries(spark):
    from lexmill.plans import corpus_plans

    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["source"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = {r["doc_id"]: (r["text_md5"], {k: r[k] for k in pii.KINDS}) for r in corpus_plans.redact_cards(spark, sf).collect()}
    want = {i: (hashlib.md5(plainly_redacted(t)[0].encode()).hexdigest(), plainly_redacted(t)[1]) for i, _, t in docs}
    assert got == want
    sums = {}
    for _, source, t in docs:
        for k, n in plainly_redacted(t)[1].items():
            sums[source, k] = sums.get((source, k), 0) + n
    assert {(r["source"], k): r[k] for r in corpus_plans.redact_counts(spark, sf).collect() for k in pii.KINDS} == sums


def test_redaction_golden(spark):
    said = "乙方身份证号：110105199001011234，联系电话：13912345678。银行卡号：6222021234567890，请将款项汇入此账户。"
    want = "乙方身份证号：110105********1234，联系电话：139****5678。银行卡号：6222****7890，请将款项汇入此账户。"
    assert pii.redact_text(said)[:2] == (want, {"id_card": 1, "phone": 1, "bank_card": 1})
    hidden = pii.redact_text("普通词​保持原样；身份证：110105​1990‌01011234。")
    assert hidden[0] == "普通词​保持原样；身份证：110105********1234。"
    assert hidden[2] == 3
    assert pii.redact_text("电话 139-1234-5678，卡号 6222 0212 3456 7890")[0] == "电话 139****5678，卡号 6222****7890"
    plain = "合同编号：20260728，金额：123456.78，条款编号：第16条。"
    assert pii.redact_text(plain)[0] == plain
    assert pii.redact_text("１１０１０５１９９００１０１１２３４")[0] == "110105********1234"
    rows = [said, plain, None, "", "电话 139-1234-5678"]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "i int, t string").select("i", pii.redacted(F.coalesce("t", F.lit(""))).alias("r")).orderBy("i").collect()
    assert [r["r"]["text"] for r in got] == [want, plain, "", "", "电话 139****5678"]


def test_specificity_golden(spark):
    s = lambda q: one(spark, text.specificity(text.english_tokens(F.lit(q))))
    assert s("learning rate scheduler") == pytest.approx(0.8)
    assert s("What is the learning rate?") == pytest.approx(0.44)
    assert s("") == pytest.approx(0.5)
    assert one(spark, text.english_tokens(F.lit("It's a state-of-the-art X1, naïve"))) == ["it's", "a", "state-of-the-art", "x1", "na", "ve"]


def test_language(spark):
    guess, sure = text.language(F.lit("这是一个中文问题"))
    assert one(spark, F.struct(guess, sure))[0] == "zh"
    assert one(spark, text.language(F.lit("abc"))[1]) == 0.0
    assert one(spark, text.bigram_tokens(F.lit("合同 期 a"))) == ["合同", "期"]


def test_uuid5_equals_python(spark):
    for ns in (uuid.NAMESPACE_DNS, uuid.NAMESPACE_URL):
        for name in ("", "a", "doc#1", "条文"):
            assert one(spark, uuid5(ns, F.lit(name))) == str(uuid.uuid5(ns, name))
    assert one(spark, numbered("clause_", F.lit(7))) == "clause_007"
    assert one(spark, signature(F.lit(1).alias("a"))) == one(spark, F.sha2(F.lit('{"a":1}'), 256))


def test_preferred_chunks(spark):
    said = "一二三四五。六七八九十；" * 20 + "x" * 90
    spans = list(split_preferred(said, 30, 8))
    assert spans[0][0] == 0 and spans[-1][1] == len(said)
    assert all(b - a <= 30 for a, b in spans)
    assert all(later[0] == (b - 8) for (_, b), later in zip(spans, spans[1:], strict=False))
    assert all(said[b - 1] in "。；" for _, b in spans[:5])
    got = preferred_chunks(spark.createDataFrame([(1, said), (2, ""), (3, "short")], "doc_id int, text string"), "text", 30, 8).orderBy("doc_id", "chunk_index").collect()
    assert [(r["start"], r["end"]) for r in got if r["doc_id"] == 1] == spans
    assert all(r["chunk"] == said[r["start"] : r["end"]] for r in got if r["doc_id"] == 1)
    assert [r["chunk"] for r in got if r["doc_id"] != 1] == ["short"]


def test_fixed_and_recursive_chunks(spark):
    got = fixed_chunks(spark.createDataFrame([("abcdefghij",), ("",)], "t string"), "t", 4, 1).collect()
    assert [r["chunk"] for r in got] == ["abcd", "defg", "ghij", ""]
    said = "\n\n".join("word " * n for n in (50, 400, 10, 3))
    parts = recursive_chunks(said, 200, 40)
    assert all(len(p) <= 200 for p in parts)
    assert set(" ".join(parts).split()) == {"word"}
    assert recursive_chunks("short") == ["short"]


def test_labels_and_forms(spark):
    c = F.lit
    assert one(spark, text.citation_label(c("法"), c("第一章"), c(""), c("第一条"))) == "《法》 第一章 第一条"
    assert one(spark, text.display_source(c("/x/data/a/b.md"))) == "a/b.md"
    assert one(spark, text.file_title(c("/x/law_20240102.docx"))) == "law_20240102"
    assert one(spark, text.file_date(c("/x/law_20240102.docx"))) == "2024-01-02"
    assert one(spark, text.fold_blanks(c(" a　\n b\t"))) == "a b"
    assert one(spark, text.trim_blank_lines(c("\n  \na\n\nb\n \n"))) == "a\n\nb"
    assert one(spark, text.visible(c("A​B­"))) == "AB"
    assert one(spark, text.percent_encode(c("a b&c"))) == "a%20b%26c"
    assert one(spark, text.string_list(c('["a"," ","b"]'))) == ["a", "b"]
    assert one(spark, text.string_list(c("plain"))) == ["plain"]
    assert len(one(spark, text.limited(c("x" * 50), 20))) <= 20
    assert one(spark, text.clean_document(c("﻿a​b c　"))) == "ab c"
    assert one(spark, text.markdown_heading(c("第一章 总则"), {"^第.+章": 2, "^第.+条": 4})) == "## 第一章 总则"


def test_spans_come_one_text_at_a_time(monkeypatch):
    """No text is a Python string before its turn; spans are those of the splitter."""
    texts = [None, "", "a" * 50, "one。two\nthree " * 9]
    seen = []
    monkeypatch.setattr(C, "split_preferred", lambda t, *n, real=C.split_preferred: seen.append(t) or real(t, *n))
    got = C.spans_of(pa.array(texts), 20, 5)
    assert seen == ["", "", *texts[2:]]
    assert [[(s["start"], s["end"]) for s in r] for r in got.to_pylist()] == [list(C.split_preferred(t or "", 20, 5)) for t in texts]
    assert C.spans_of(pa.array([], pa.string()), 20, 5).to_pylist() == []
