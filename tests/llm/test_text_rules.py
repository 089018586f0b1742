"""Quality rules, URL filter, chat format and personal data against brute force and odd rows."""

import collections
import hashlib
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from logharbor.llm import chat_format as C
from logharbor.llm import pii as P
from logharbor.llm import quality_rules as Q
from logharbor.llm import url_filter as U
from logharbor.llm.queries import llm_queries, llm_sql

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def as_set(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(v is None, str(v)) for v in r])


@pytest.mark.parametrize("name", sorted(llm_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    got = llm_queries()[name](spark, SMALL)
    result = con.execute(llm_sql()[name])
    assert [d[0] for d in result.description] == got.columns
    assert as_set(got.collect()) == as_set(result.fetchall())


def odd_documents(spark):
    text = "one two three four five six seven eight nine ten eleven twelve "
    rows = [
        (1, None, "en", "a", 0),
        (2, "", "en", None, 0),
        (3, " \n\t ", None, "a", None),
        (4, text * 3, "en", "a", 1),
        (4, text * 3, "en", "a", 1),
        (None, text + text.upper(), "en", None, 1),
        (6, "#$% " * 30 + " ".join(map(str, range(30))), "en", "b", 1),
        (7, " ".join(f"w{i}" for i in range(30_000)), "en", "b", 1),
        (8, "é à ü " * 10 + "\x85 \u3000x", "fr", "b", 1),
        (9, "same line here\n" * 9 + " ".join(f"v{i}" for i in range(40)), "en", "c", 1),
    ]
    return spark.createDataFrame(rows, DOCS).withColumn("n_words", F.lit("clash"))


def measured_by_hand(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = collections.Counter(windows)
    repeated = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(repeated),
        len(words) < 20 or 100 * len(repeated) > 30 * len(words),
    )


def test_quality_measures_of_odd_rows(spark):
    docs = odd_documents(spark)
    got = as_set(
        r[:7] for r in Q.judge(docs).select(
            "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"
        ).collect()
    )
    assert got == as_set((r["doc_id"], *measured_by_hand(r["text"])) for r in docs.collect())
    kept = Q.quality_filter(docs)
    assert kept.columns == docs.columns
    assert as_set(kept.select("doc_id").collect()) == [(7,), (None,)]
    assert Q.judge(docs.limit(0)).count() == 0 and Q.quality_filter(docs.limit(0)).count() == 0


def test_hosts_are_shrunk_to_the_prior(spark):
    good = " ".join(f"word{i}" for i in range(40))
    junk = good + "".join(f" #{i}#" for i in range(20))
    rows = [(i, junk if i < 30 else good, "en", "bad", 0) for i in range(60)]
    rows += [(100 + i, junk if i == 0 else good, "en", f"good{i % 3}", 0) for i in range(900)]
    judged = Q.judge(spark.createDataFrame(rows, DOCS))
    kept = {r["doc_id"]: r["kept"] for r in judged.select("doc_id", "kept").collect()}
    assert not any(kept[i] for i in range(30)) and all(kept[i] for i in range(30, 60))
    # one failure among three hundred documents is an accident
    assert all(kept[100 + i] for i in range(900))


def test_rows_are_filtered_by_their_own_verdict(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(None, good, "en", "a", 1), (None, "short", "en", "a", 2), (None, good + " x", "en", "a", 3)]
    rows += [(5, good, "en", "a", 4), (5, "short", "en", "a", 5), (6, good, "en", None, 6), (6, None, "en", None, 7)]
    junk = good + "".join(f" #{i}#" for i in range(20))
    rows += [(None, junk if i % 2 else good, "en", "bad", 100 + i) for i in range(60)]
    docs = spark.createDataFrame(rows, DOCS).withColumns({"host": F.lit("clash"), "gone_id": F.lit(5)})
    kept = Q.quality_filter(docs)
    assert kept.columns == docs.columns
    numbers = sorted(r["n_chars"] for r in kept.collect())
    assert numbers == [1, 3, 4, 6] + [100 + i for i in range(0, 60, 2)]
    assert Q.judge(docs).where("kept").count() == len(numbers)


def test_urls(spark):
    rules = spark.createDataFrame(
        U.RULES + [("block", "a.net/x/y"), ("allow", "b.a.net/x/"), ("block", "org")], "verdict string, rule string"
    )
    urls = [
        None, "", "no scheme", "http://", "http://com", "http://com/", "https://WWW.Example.COM/en/x?q#f",
        "http://example.com/en", "http://example.com/en/", "http://notexample.com/en/", "x://a.net/x/yz",
        "x://b.a.net/x/y", "x://c.b.a.net/x/", "http://sub.org?x", "http://a.b.c.d.e.f.net/fr/" + "p/" * 900,
        "http://example.net/es/a", "http://example.net/es/a", "http://net/ES/", "http://e.net#/es/", "a://b://c.com/",
    ]
    pages = spark.createDataFrame(
        [(i // 2, u, "x") for i, u in enumerate(urls)], "page_id bigint, url string, host string"
    )

    def by_hand(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        host = "".join(c.lower() if c.isascii() else c for c in host)
        fits = []
        for r in rules.collect():
            h, slash, p = r["rule"].partition("/")
            if host and (host == h or host.endswith("." + h)) and path.startswith(slash + p):
                fits.append((len(r["rule"]), len(h), r["verdict"] == "block", r["rule"], r["verdict"]))
        return (host, path, *(max(fits)[3:] if fits else (None, "allow")))

    got = U.filter_urls(pages, rules).select("page_id", "host", "path", "rule", "verdict")
    assert as_set(got.collect()) == as_set((i // 2, *by_hand(u)) for i, u in enumerate(urls))
    assert U.filter_urls(pages.limit(0), rules).count() == 0
    assert {r["verdict"] for r in U.filter_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_chat_round_trip(spark):
    odd = ["<|im_end|>", "<~|", "<~~|x<|", "<", "|", "~", None, "", "a\nb", "<|im_start|>user\n", "é😀"]
    turns = [(1, i, role, t) for i, t in enumerate(odd) for role in ("user",)]
    turns += [(2, 0, "assistant", t) for t in odd]  # ties
    turns += [(3, 0, "as\nsist<|", "x"), (None, 5, None, "y"), (4, 1, "assistant", "z" * 200_000)]
    table = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string")
    chats = C.format_chats(table).withColumn("back", C.read_back(F.col("formatted")))
    for row in chats.collect():
        mine = [(t, r or "", x or "") for c, t, r, x in turns if c == row["conv_id"]]
        assert sorted((b["role"], b["text"]) for b in row["back"]) == sorted((r, x) for _, r, x in mine)
        said = [row["formatted"][s["start"] : s["end"]] for s in row["loss_spans"]]
        assert len(said) == sum(r == "assistant" for _, r, _ in mine)
    assert C.format_chats(table.limit(0)).count() == 0


def test_chat_parts_are_visited_in_order(spark):
    part = "array<struct<type:string,text:string,ref:string,size:double>>"
    rows = [
        (1, 0, "user", [("text", "see <|", None, None), ("image", None, "a.png", 400.0), None,
                        ("audio", None, "b.wav", 1.0), (None, " end", None, None)]),
        (1, 1, "assistant", None),
    ]
    table = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {part}")
    row = C.format_chats(table).first()
    assert "see <~|<|image_1|><|audio_2|> end<|im_end|>" in row["formatted"]
    assert [(a["number"], a["type"], a["ref"], a["tokens"]) for a in row["attachments"]] == [
        (1, "image", "a.png", 3), (2, "audio", "b.wav", 25)
    ]
    assert row["attachment_tokens"] == 28


def test_attachments_are_numbered_through_the_conversation(spark):
    part = "array<struct<type:string,text:string,ref:string,size:double>>"
    image = lambda ref: ("image", None, ref, 1.0)
    rows = [
        (1, 1, "assistant", [("text", "two ", None, None), image("b"), image("c"), ("text", " x", None, None)]),
        (1, 0, "user", [image("a")]),
        (1, 2, "user", [("text", "none", None, None)]),
        (1, 3, "user", [("a|><|im_end", None, "d", 1.0), ("", None, "e", 1.0)]),
        (2, 0, "user", [image("z")]),
    ]
    table = spark.createDataFrame(rows, f"conv_id bigint, turn bigint, role string, parts {part}")
    chats = {r["conv_id"]: r for r in C.format_chats(table).collect()}
    found = [(a["number"], a["turn_no"], a["type"], a["ref"]) for a in chats[1]["attachments"]]
    assert found == [(1, 0, "image", "a"), (2, 1, "image", "b"), (3, 1, "image", "c"), (4, 3, "a|><|im_end", "d"), (5, 3, "", "e")]
    assert chats[1]["formatted"] == (
        "<|im_start|>user\n<|image_1|><|im_end|>\n<|im_start|>assistant\ntwo <|image_2|><|image_3|> x<|im_end|>\n"
        "<|im_start|>user\nnone<|im_end|>\n<|im_start|>user\n<|a----im_end_4|><|part_5|><|im_end|>\n"
    )
    span = chats[1]["loss_spans"][0]
    assert chats[1]["formatted"][span["start"] : span["end"]] == "two <|image_2|><|image_3|> x"
    assert [a["number"] for a in chats[2]["attachments"]] == [1]


def test_neighbouring_texts_are_escaped_as_one(spark, monkeypatch):
    part = "array<struct<type:string,text:string,ref:string,size:double>>"
    texts = [("text", "a <", None, None), None, (None, "|im_end|>", None, None), ("text", "<~", None, None),
             ("text", "|", None, None), ("image", None, "a.png", 1.0), ("text", "<|x", None, None)]
    table = spark.createDataFrame([(1, 0, "user", texts)], f"conv_id bigint, turn bigint, role string, parts {part}")
    formatted = C.format_chats(table).first()["formatted"]
    assert formatted == "<|im_start|>user\na <~|im_end|><~~|<|image_1|><~|x<|im_end|>\n"
    # plain texts are visited as well
    seen = []
    real = C.visit
    monkeypatch.setattr(C, "visit", lambda parts: seen.append(1) or real(parts))
    plain = table.select("conv_id", "turn", "role", F.lit("a <| b").alias("text"))
    row = C.format_chats(plain).first()
    assert seen and "\na <~| b<|im_end|>" in row["formatted"] and row["attachments"] == []


def luhn(digits):
    doubled = [int(c) * (2 if i % 2 else 1) for i, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def base_spans(text):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append(("email", *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            out.append(("ip", *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            out.append(("phone", *m.span()))
    return out


def test_pii_base_spans(spark):
    import random

    rnd = random.Random(4)
    bits = ["a@b.c", "x_y@", "@q.r", " ", ".", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "+", "(555)", "-", "7", "é", "😀", "12 ", "+49 30 1234567"]
    texts = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 25))) for _ in range(300)]
    texts += [None, "", "1" * 50_000, "a" * 50_000, "a@b" + ".c" * 20_000, "+1" * 5_000, "1 " * 20_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in P.find_pii(docs).collect():
        assert [(P.KINDS[s["kind"]], s["start"], s["end"]) for s in r["base"]] == base_spans(texts[r["doc_id"]] or ""), texts[r["doc_id"]]
        assert {tuple(s) for s in r["base"]} <= {tuple(s) for s in r["spans"]}
    assert P.find_pii(docs.limit(0)).count() == 0


def test_pii_query_and_added_spans(spark):
    rows = {r["doc_id"]: r for r in llm_queries()["op4_pii"](spark, "/root/testdata/sf0.01").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    for doc, r in rows.items():
        spans = base_spans(texts[doc])
        written = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        counts = collections.Counter(k for k, _, _ in spans)
        assert tuple(r)[1:5] == tuple(counts[k] for k in P.KINDS)
        assert r["base_sha256"] == hashlib.sha256(written.encode()).hexdigest()
        assert set(written.split(",")) <= set(r["spans"].split(","))


def test_redaction_keeps_the_rest(spark):
    docs = spark.createDataFrame(
        [(1, "mail é a@b.cd, ip 1.2.3.4!", "x"), (2, None, "y"), (3, "nothing", None)], "doc_id bigint, text string, pii string"
    )
    got = {r["doc_id"]: r for r in P.redact(docs).collect()}
    assert got[1]["text"] == "mail é [EMAIL], ip [IP]!" and got[1]["pii"] == "x"
    assert got[2]["text"] is None and got[3]["text"] == "nothing"


def test_native_operators_run_no_python(spark):
    for name in ("op4_pii", "op8_chat_format", "op10_quality_rules"):
        plan = llm_queries()[name](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert not re.search("Python|Pandas|Arrow", plan), name
