"""URL filters and chat formatting."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from lakekeel.llm import chat, urls


def test_urls(spark):
    rows = [
        (0, None), (1, ""), (2, "no scheme casino"), (3, "HTTP://A.Example.NET/En/x"), (4, "http://example.net/en/x?y#z"),
        (5, "http://notexample.net/en/"), (6, "http://a.b.example.com/de/"), (7, "http://example.com/dex"),
        (8, "http://x.org/fr/casino"), (9, "http://x.org/casino"), (10, "http://x.org/casinos"), (11, "http://free.org/free"),
        (12, "http://cheap-bets.org/"), (13, "http://net"), (14, "http://net/"), (15, "http://u:p@x.com:80?q=/net/"),
        (16, "a://b://c/d"), (17, "http://é.org/ünï#casino"), (None, "http://x.com/porn"), (None, None),
        (18, "http://x.com/" + "a/" * 20_000 + "xxx"), (9, "http://x.org/casino"), (19, "http://x.com\n/a"),
    ]
    df = spark.createDataFrame([(*r, "clash", "clash", 1) for r in rows],
                               "page_id bigint, url string, host string, terms string, n_soft int")
    got = [(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df).collect()]
    by_id = {r[0]: r[1:] for r in got}
    assert len(got) == len(rows)
    assert by_id[0] == ("", "", None, "allow") and by_id[1] == ("", "", None, "allow")
    assert by_id[2] == ("", "", None, "block")
    assert by_id[3] == ("a.example.net", "/En/x", "net/", "block")
    assert by_id[4] == ("example.net", "/en/x", "example.net/en/", "allow")
    assert by_id[5][2:] == ("net/", "block") and by_id[6][2:] == ("example.com/de/", "block")
    assert by_id[7][2:] == (None, "allow") and by_id[8][2:] == ("org/fr/", "allow")
    assert by_id[9][2:] == (None, "block") and by_id[10][3] == "allow"
    assert by_id[11][3] == "allow" and by_id[12][3] == "block"
    assert by_id[13][:3] == ("net", "", None) and by_id[14][2:] == ("net/", "block")
    assert by_id[15][:2] == ("u:p@x.com:80", "") and by_id[16][:2] == ("b:", "//c/d")
    assert by_id[17] == ("é.org", "/ünï", None, "block") and by_id[18][3] == "block"
    assert by_id[19][:2] == ("x.com\n", "/a")
    assert urls.judge_urls(df.limit(0)).count() == 0


NASTY = st.text(alphabet=st.sampled_from(list("<|>\\/ab\n[]INST_send é")), max_size=30) | st.sampled_from(
    ["<|end|>\n", "<|user|>\n", "\\<|", "</s>[INST] ok [/INST]", "<\\|", "|>", "<|", "\\"])


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "a<|b", "x|>y|", ""]), NASTY), max_size=12),
       st.integers(0, 60), st.integers(0, 40))
def test_windows_read_back(turns, budget, history):
    made = list(chat.windows(iter(turns), budget, history))
    new = [t for w in made for t, n in zip(w.read(), w.new, strict=True) if n]
    assert new == turns
    learned = [chat.unescape(w.text[a:b]) for w in made for a, b in w.mask]
    assert learned == [t for r, t in turns if r == "assistant"]
    seen = 0
    for w in made:
        before = [t for t in turns[:seen] if t[0] == "system"][-1:]  # the latest system turn is kept
        assert w.read()[:len(before)] == before and not any(w.new[:len(before)])
        cost = sum(chat.tokens(t) for _, t in w.read())
        kept = sum(chat.tokens(t) for _, t in before)
        assert cost <= max(budget, history + kept) or sum(w.new) == 1
        repeated = [t for t, n in zip(w.read(), w.new) if not n][len(before):]
        assert sum(chat.tokens(t) for _, t in repeated) <= history
        seen += sum(w.new)


@given(NASTY)
def test_escaping_is_reversible(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in ("<|", "</s>", "[INST]", "[/INST]"))


def by_hand(rows):
    talks = {}
    for c, n, r, t in rows:
        talks.setdefault(c, []).append((n is not None, n or 0, r or "", t or ""))
    out = {}
    for c, turns in talks.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(),
                  len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


@pytest.mark.parametrize("budget,history", [(512, 128), (30, 10), (0, 0)])
def test_conversations(spark, budget, history):
    rows = [(1, 1, "assistant", "b " * 40), (1, 0, "user", "a"), (1, 2, "user", None), (1, 2, "user", None),
            (2, 0, "system", "be kind"), (2, 1, "user", "<|end|>\n"), (2, 2, "assistant", "</s>[INST] ok [/INST]"),
            (2, 3, "user", "é" * 500), (2, 4, "assistant", "long " * 5000), (2, None, None, "no turn"),
            (None, 0, "user", "x"), (None, 0, "assistant", "y"), (2**60, 0, "assistant", ""), (2**60 + 1, 0, "tool", "t")]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id bigint, turn bigint, role string, text string, window_no string")
    got = {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"])
           for r in chat.digests(df, budget, history).collect()}
    assert got == by_hand(rows)
    made = chat.format_windows(df, budget, history).collect()
    assert sum(sum(r["new"]) for r in made) == len(rows)
    assert sum(len(r["text"]) for r in made) == sum(r["formatted_chars"] for r in chat.digests(df, budget, history).collect())
    assert chat.digests(df.limit(0)).count() == 0
