"""Personal data, BPE, token counts, chat, page text and licences against plain restatements."""

import hashlib
import random
import re
import struct

import pytest
from tokenizers import Tokenizer

from noticelake.llm import bpe, chat, html_text, license_scan, pii, token_count
from noticelake.llm.queries import HOSTILE, op1_chat

from .conftest import LONG, SF

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)

    def luhn(number):
        total = sum(int(c) for c in number[-1::-2]) + sum(sum(map(int, str(2 * int(c)))) for c in number[-2::-2])
        return total % 10 == 0

    found = [("email", *m.span()) for m in EMAIL.finditer(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    found += [("card", *m.span()) for m in CARD.finditer(text) if 14 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 10 <= len(digits(m[0])) <= 15]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def written(spans):
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def test_base_spans_on_made_up_texts():
    rng = random.Random(7)
    for _ in range(3_000):
        text = "".join(rng.choice("a1@.+- %_(2)405Z\n9") for _ in range(rng.randrange(60)))
        assert [s[:3] for s in pii.find_spans(text) if s[4]] == base_spans(text), text


def test_pii_report(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        got = sorted((tuple(r)[:6] for r in pii.pii_report(df).collect()), key=str)
        want = []
        for r in df.collect():
            spans = base_spans(r.text or "")
            counts = [sum(k == s[0] for s in spans) for k in KINDS]
            want.append((r.doc_id, *counts, hashlib.sha256(written(spans).encode()).hexdigest()))
        assert got == sorted(want, key=str)
    assert pii.pii_report(no_docs).count() == 0


def test_checksums_and_context():
    assert pii.mod97("GB82WEST12345698765432") and not pii.mod97("GB82WEST12345698765433")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")
    kinds = lambda t: [s[0] for s in pii.find_spans(t) if not s[4]]
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32 please") == ["iban"]
    assert kinds("call (201) 555-0100 now") == ["phone"] and kinds("room (201) 555-0100 now") == []
    assert kinds("his ssn is 123-45-6789") == ["ssn"] and kinds("part 123-45-6789") == []
    assert pii.redact("a@b.co x", pii.find_spans("a@b.co x")) == "<EMAIL> x"


def test_long_runs_are_read_in_linear_time():
    assert pii.find_spans("a" * 200_000 + "1" * 200_000 + "." * 100_000) == []


@pytest.fixture(scope="module")
def coder():
    return bpe.ByteBpe(open(bpe.vocabulary_path(), encoding="utf-8").read())


def test_bpe_equals_the_library(coder):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    rng = random.Random(3)
    pool = "abcdefghetainors  ABC.\n019éßя漢😀ͰÿĀ՘\x1c\x85 '’"
    texts = ["".join(rng.choice(pool) for _ in range(rng.randrange(90))) for _ in range(3_000)]
    texts += ["", "x<|endoftext|>y <|endoftext|><|endoftext|>", "aé" * 900, "a" * 3_000, LONG, "I'll don't 'S"]
    for text, want in zip(texts, library.encode_batch(texts, add_special_tokens=False), strict=True):
        packed = coder.encode_packed(text)
        assert list(struct.unpack(f"<{len(packed) // 4}I", packed)) == want.ids
        assert coder.count(text) == len(want.ids)
        assert coder.decode_packed(packed) == library.decode(want.ids, skip_special_tokens=False) == text


def test_forced_cuts_are_where_no_token_has_the_pair(coder):
    fragments = coder.fragments_of(" the漢字")
    assert "".join(fragments) == " the漢字".encode().decode("latin-1").translate(coder.letter) and len(fragments) > 1
    assert all(p in coder.inside for f in fragments for p in zip(f, f[1:], strict=False))


def test_bpe_and_counts_on_odd_rows(odd_docs, no_docs):
    library = Tokenizer.from_file(bpe.vocabulary_path())
    want = sorted(((r.doc_id or -1), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in odd_docs.collect())
    assert sorted(((r.doc_id or -1), r.n_tokens) for r in bpe.bpe_report(odd_docs).collect()) == want
    counted = token_count.count_tokens(odd_docs, sample_rows=3, table_size=5).collect()
    assert sorted(((r.doc_id or -1), r.n_tokens) for r in counted) == want
    assert all(r.over_limit == (r.n_tokens > 512) for r in counted)
    assert bpe.bpe_report(no_docs).count() == 0 and token_count.count_tokens(no_docs).count() == 0
    stage = bpe.with_tokens(odd_docs, "ids", "n")
    assert stage.columns == [*odd_docs.columns, "ids", "n", "restored"] and stage.count() == odd_docs.count() and all(r.restored for r in stage.collect())


def test_chat_is_read_back(spark):
    rows = spark.read.parquet(f"{SF}/conversations.parquet").collect()
    got = {r.conv_id: r for r in op1_chat(spark, SF).collect()}
    talks = {}
    for r in rows:
        talks.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    talks[-1] = [(0, "user", HOSTILE), (1, "assistant", HOSTILE)]
    assert set(got) == set(talks)
    for key, turns in talks.items():
        turns = sorted(turns)
        spoken = "".join(f"{role}\n{text}\n" for _, role, text in turns)
        loss = "".join(text for _, role, text in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        r = got[key]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha(spoken), len(loss), sha(loss))


def test_chat_layouts_and_escapes(spark):
    texts = ["<|turn|>x<|end|>", "a\\b\\\\c", "<s></s>[INST]<<SYS>>\\", "\\<|text|>", "", None, "</s\\>"]
    rows = [(i, [(t, "human"), (t, "gpt")]) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "conv_id long, conversations array<struct<value:string,`from`:string>>")
    other = spark.createDataFrame([(100, "do", "with", "done")], "conv_id long, instruction string, input string, output string")
    unknown = spark.createDataFrame([(200, "?")], "conv_id long, riddle string")
    both = df.unionByName(other, allowMissingColumns=True).unionByName(unknown, allowMissingColumns=True)
    done = chat.format_turns(chat.canonical_turns(both))
    back = {r.conv_id: (r.back, r.formatted, r.loss) for r in done.select("conv_id", "formatted", chat.read_back(done.formatted).alias("back"), chat.masked_text(done.formatted, done.loss_mask).alias("loss")).collect()}
    for i, t in enumerate(texts):
        assert [(x.role, x.text) for x in back[i][0]] == [("user", t or ""), ("assistant", t or "")] and back[i][2] == (t or "")
        assert back[i][1].count("<|turn|>") == 2 and "</s>" not in back[i][1] and "[INST]" not in back[i][1]
    assert [(x.role, x.text) for x in back[100][0]] == [("user", "do\n\nwith"), ("assistant", "done")]
    assert back[200][0] == []


def test_null_turns(spark):
    rows = [(1, None, None, None), (1, 1, "user", "b"), (1, 1, "user", "b"), (None, 0, "user", "q")]
    got = {r.conv_id: r.n_turns for r in chat.chat_report(chat.gather_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert got == {1: 3, None: 1}


PAGE = (
    "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><header><a href=/>Home</a></header>"
    "<nav><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></nav><div class='cookie-notice'>We use cookies on this site.</div><!-- ad -->"
    "<article><h1>A &amp; B</h1><p><b>First   para&shy;graph.<br>goes on</b><p>1 &lt; 2 and 3 < 4.</p><div class=\"ad\">Buy now</div><p>Short.</p></article>"
    "<aside>Related</aside><section id=comments><p>I think that this is a long reader comment of no use.</p></section><form><p>Sign up</p></form><footer>&copy; x</footer>"
)


def test_page_text():
    assert html_text.main_text(PAGE) == "A & B\n\nFirst para­graph. goes on\n\n1 < 2 and 3 < 4.\n\nShort."
    assert html_text.main_text("") == "" and html_text.main_text("<p") == "" and html_text.main_text("<script>x") == ""
    assert html_text.main_text("<div>" * 20_000 + "text of some more words here now again and again</div>") != ""


def test_pages_of_the_table(spark):
    import html as h

    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_text.extract_text(pages).collect()}
    for r in pages.collect():
        body = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        parts = [" ".join(h.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", "\n"))).split()) for p in re.split(r"</?(?:p|h1)>", body)]
        assert got[r.page_id].text == "\n\n".join(p for p in parts if p) and got[r.page_id].n_chars == len(got[r.page_id].text)
    odd = spark.createDataFrame([(1, None, None, "t"), (None, "u", "", "t")], "page_id long, url string, html string, text string")
    assert [(r.text, r.n_chars) for r in html_text.extract_text(odd).collect()] == [("", 0), ("", 0)]


def test_licences(docs, odd_docs, no_docs):
    phrases = {
        "Licensed under CC BY-NC 4.0.": "cc-by-nc",
        "This work is licensed under the GNU General Public License, version 3.": "gpl",
        "Licensed under the Apache License, Version 2.0.": "apache-2.0",
        "Released under the MIT License.": "mit",
        "All rights reserved.": "proprietary",
    }
    got = {r.doc_id: r for r in license_scan.license_report(docs).collect()}
    for r in docs.collect():
        want = {f for p, f in phrases.items() if p in r.text.split("\n")}
        assert set(filter(None, got[r.doc_id].families.split(","))) == want
    assert license_scan.license_report(odd_docs).filter("families <> ''").count() == 0
    assert license_scan.license_report(no_docs).count() == 0
    assert license_scan.scan("the license of the house\nsee the apache helicopter license") == []


def test_each_template_phrase_is_told():
    for family, texts in license_scan.TEMPLATES.items():
        for phrase in texts:
            assert license_scan.agrees(license_scan.line_words(phrase), family)
            assert license_scan.promising([phrase.split()]) == [True]
    p = license_scan.probabilities(license_scan.line_words("a stone in the garden of words"))
    assert license_scan.FAMILIES[p.argmax()] == license_scan.UNKNOWN
