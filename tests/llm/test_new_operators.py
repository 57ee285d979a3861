"""Chat windows, phrases and tokenizer alignment: against brute force and on the odd cases."""

from __future__ import annotations

import collections
import hashlib
import random
import re

import pytest

from visitline.llm import alignment, chat, phrases

TURNS = "conv_id long, turn long, role string, text string, tokens long, start string"


def _turns(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], TURNS).repartition(5)


def _read(spark, rows, **settings):
    """Windows with their turns by conversation, in order."""
    windows = chat.chat_windows(_turns(spark, rows), **settings)
    read = {(r["conv_id"], r["window"]): r for r in chat.read_windows(windows).collect()}
    out = collections.defaultdict(list)
    for w in sorted(windows.collect(), key=lambda w: (w["conv_id"] is not None, w["conv_id"], w["window"])):
        out[w["conv_id"]].append((w, read[w["conv_id"], w["window"]]))
    return out


def _said(windows):
    return [tuple(t) for _, r in windows for t in r["turns"]], [t for _, r in windows for t in r["learned"]]


def _plain_tokens(text):
    return max(len(re.findall(r"[^\x20\x09-\x0D]+", text)), -(-len(text) // 4)) + 4


def _parsed(formatted):
    """(role, text) of every turn by a plain reading of the template."""
    out = []
    for part in formatted.split("</turn>\n")[:-1]:
        head, body = part.split("\n", 1)
        role = head.removeprefix("<turn ").replace("%0A", "\n").replace("%3C", "<").replace("%25", "%")
        out.append((role, re.sub(r"<\\(\\*)(/?turn)", r"<\1\2", body)))
    return out


@pytest.mark.parametrize("bucket_turns", [3, 1024])
def test_windows_hold_every_turn_once_within_the_budget(spark, bucket_turns):
    rng = random.Random(7)
    rows, by_conv = [], collections.defaultdict(list)
    for conv in range(40):
        for i in range(rng.choice([1, 2, 7, 60])):
            role = "system" if i == 0 and conv % 3 == 0 else rng.choice(["user", "assistant", "assistant", "system"])
            text = " ".join(rng.choice(["ab", "<turn x", "</turn>\n", "<\\turn", "é😀", "\\", "<"]) for _ in range(rng.choice([0, 3, 30, 200 if conv < 9 else 40])))
            rows.append((conv, i, role, text))
            by_conv[conv].append((role, text))
    got = _read(spark, rows, budget=200, history=32, bucket_turns=bucket_turns)
    assert set(got) == set(by_conv)
    for conv, turns in by_conv.items():
        said, learned = _said(got[conv])
        assert said == turns and learned == [t for r, t in turns if r == "assistant"]
        system = turns[0] if turns[0][0] == "system" else None
        done = 0
        for k, (w, _) in enumerate(got[conv]):
            parsed = _parsed(w["formatted"])
            new = parsed[w["n_repeated"]:]
            assert len(parsed) == w["n_turns"] and new == turns[done : done + len(new)] and new
            again = parsed[: w["n_repeated"]]
            if system and k:
                assert again[0] == system
                again = again[1:]
            # what is repeated are the last turns before the window, as many as the history has room for
            history = turns[1 if system else 0 : done]
            fits = next(n for n in range(len(history), -1, -1) if sum(_plain_tokens(t) for _, t in history[len(history) - n :]) <= 32)
            assert again == history[len(history) - fits :]
            size, fixed = sum(_plain_tokens(t) for _, t in parsed), _plain_tokens(system[1]) if system else 0
            assert size <= 200 or fixed > 200 - 32 - 50 or len(new) - (1 if system and not k else 0) == 1
            done += len(new)
        assert done == len(turns)
        for w, r in got[conv]:
            assert [w["formatted"][s["start"] : s["end"]] for s in w["loss"]] == [chat_escape(t) for t in r["learned"]]


def chat_escape(text):
    return re.sub(r"<(\\*)(/?turn)", r"<\\\1\2", text)


def test_windows_of_odd_turns(spark):
    rows = [
        (1, None, None, None), (1, 0, "a%0A<\nb", "x"), (1, 0, "assistant", "tie b"), (1, 0, "assistant", "tie a"), (1, 5, "assistant", "twice"), (1, 5, "assistant", "twice"),
        (2, 0, "system", "only a system turn"), (None, 3, "assistant", "no id"), (None, None, "system", "no id either"),
        (3, 0, "system", "s " * 3000), (3, 1, "assistant", "</turn>" * 2000), (3, 2, "user", "<\\\\turn </turn"), (3, 3, "assistant", ""), (3, 10**12, "assistant", "far"), (3, -4, "user", "first"),
    ]
    got = _read(spark, rows)
    assert _said(got[1])[0] == [("", ""), ("a%0A<\nb", "x"), ("assistant", "tie a"), ("assistant", "tie b"), ("assistant", "twice"), ("assistant", "twice")]
    assert _said(got[1])[1] == ["tie a", "tie b", "twice", "twice"]
    assert _said(got[2]) == ([("system", "only a system turn")], [])
    assert _said(got[None]) == ([("system", "no id either"), ("assistant", "no id")], ["no id"])
    assert _said(got[3])[0] == [(r, t) for _, _, r, t in sorted((x for x in rows if x[0] == 3), key=lambda x: x[1])]
    assert chat.chat_windows(_turns(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.chat_windows(_turns(spark, rows), budget=100, history=50)


def test_a_conversation_with_most_turns_is_summed_in_many_buckets(spark):
    rows = [(9, i, "user" if i % 2 else "assistant", f"word {i}") for i in range(5000)] + [(i + 10, 0, "user", "x") for i in range(20)]
    windows = chat.chat_windows(_turns(spark, rows), budget=64, history=10, bucket_turns=128)
    plan = windows._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    got = _read(spark, rows, budget=64, history=10, bucket_turns=128)
    assert _said(got[9])[0] == [(r, t) for c, _, r, t in rows if c == 9]


# phrases


def _phrases_by_force(rows, least, absorbed=(80, 100)):
    """{(lang, phrase): (a, l, r, n, score)} of ``(text, lang)``."""
    counts, n_words = collections.Counter(), collections.Counter()
    for text, lang in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            found = tuple(re.findall(r"[^\x20\x09]+", piece))
            n_words[lang or "und"] += len(found)
            counts.update((lang or "und", found[i : i + k]) for k in (1, 2, 3, 4) for i in range(len(found) - k + 1))
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in candidates.items():
        holds = (b for (other, q), b in candidates.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))))
        if any(absorbed[1] * b >= absorbed[0] * a for b in holds):
            continue
        score, k = min((2_000_000 * a // (counts[lang, p[:k]] + counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang, " ".join(p)] = (a, counts[lang, p[:k]], counts[lang, p[k:]], n_words[lang], score)
    return out


@pytest.mark.parametrize("least", [2, 5])
def test_phrases_equal_brute_force(spark, least):
    rng = random.Random(least)
    vocabulary = ["a", "B", "b", "é", "wörd", "x-y", "the", "of", "of the"]
    rows = []
    for i in range(120):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t ", ", ", "\n", ".", "  ", "\x0b"]) for _ in range(rng.choice([0, 1, 5, 60])))
        rows.append((text, rng.choice(["en", "de", None, "Ü"])))
    rows += [(None, "en"), ("", None), (" \n;", "fr"), ("solo", "fr"), ("one two three four five", "en"), ("one two three four five", "en"), ("longword" * 3000, "en"), ("q w " * 6000, "xx")]
    docs = spark.createDataFrame([(*r, "clash", 3) for r in rows], "text string, lang string, phrase string, n long").repartition(4)
    got = phrases.collocations(docs, least=least)
    assert {(r["lang"], r["phrase"]): (r["a"], r["l"], r["r"], r["n"], r["score"]) for r in got.collect()} == _phrases_by_force(rows, least)
    best = phrases.best_phrases(got, 3).collect()
    for lang in {r["lang"] for r in best}:
        mine = sorted((-v[4], -v[0], k[1].encode()) for k, v in _phrases_by_force(rows, least).items() if k[0] == lang)[:3]
        assert [(r["rank"], r["phrase"]) for r in sorted((r for r in best if r["lang"] == lang), key=lambda r: r["rank"])] == [(i + 1, m[2].decode()) for i, m in enumerate(mine)]


def test_phrases_of_nothing_and_of_a_text_above_a_piece(spark):
    docs = spark.createDataFrame([("x y z. " * 700_000, "en"), ("tail end", "en")], "text string, lang string")
    got = {r["phrase"]: (r["a"], r["n"]) for r in phrases.collocations(docs).collect()}
    assert got == {"x y z": (700_000, 2_100_002)}
    assert phrases.collocations(docs.limit(0)).count() == 0
    assert phrases.collocations(docs.where("text = 'tail end'")).count() == 0


# alignment


FIRST, SECOND = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MIXED = [
    None, "", " ", "\n", "a", " a", "a  b", "tab\tand\nline\r\n\n end ", "é ü ñ 一二三 😀😀 🏳️‍🌈 𐍈 ﬁ ①", "<|endoftext|> <s> </s> <unk> <0x41>", "don't we'll I'M 12345 3.14",
    "▁ already", "x▁y", "\x00\x01 nul", "\xa0non breaking lines 　 x", "é combining", "word " * 4000, "x" * 3000, "ab" * 2000 + " 😀" * 500, "line\nline\nline two\n\nline",
    "same text here", "same text here", "पाठ यहाँ है العربية עברית ไทย", " lead", "trail ", "a​b ﻿ c",
]


def _aligned_by_force(texts):
    """Per text n_a, n_b, groups, links from the tokens' bytes alone, each text encoded as a whole."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FIRST)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=SECOND)
    table, extra = {}, 0
    for byte in range(256):
        if 33 <= byte <= 126 or 161 <= byte <= 172 or 174 <= byte:
            table[chr(byte)] = byte
        else:
            table[chr(256 + extra)], extra = byte, extra + 1
    names = {i: bytes(table[c] for c in t) for t, i in a.get_vocab().items() if all(c in table for c in t)}
    out = []
    for text in texts:
        ids_a = a.encode(" " + text, add_special_tokens=False).ids if text else []
        ids_b = b.encode(text) if text else []
        bytes_a = [names[i] for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not text or b"".join(bytes_a) != f" {text}".encode() or b"".join(bytes_b) != f" {text}".encode():
            out.append((0, 0, "", []))
            continue
        ends_a, ends_b = ([sum(map(len, x[: i + 1])) for i in range(len(x))] for x in (bytes_a, bytes_b)) if len(text) < 200 else map(_running, (bytes_a, bytes_b))
        shared = set(ends_a) & set(ends_b)
        groups, own_a, own_b, i, j, links = [], [], [], 0, 0, []
        while i < len(ids_a):
            own_a.append(ids_a[i])
            if ends_a[i] in shared:
                while j < len(ids_b) and ends_b[j] <= ends_a[i]:
                    own_b.append(ids_b[j])
                    j += 1
                links.append((own_a[-1], own_b[-1]))
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                own_a, own_b = [], []
            i += 1
        out.append((len(ids_a), len(ids_b), ";".join(groups), links))
    return out


def _running(parts):
    out, end = [], 0
    for p in parts:
        end += len(p)
        out.append(end)
    return out


def _check_alignment(spark, texts, rows=None):
    docs = rows if rows is not None else spark.createDataFrame([(i, t, 9, "clash") for i, t in enumerate(texts)], "doc_id long, text string, n_a long, groups string").repartition(3)
    aligned = alignment.align_tokens(docs, FIRST, SECOND)
    got = {r["doc_id"]: r for r in alignment.score_links(aligned, alignment.piece_count(SECOND)).collect()}
    want = _aligned_by_force(texts)
    counts = collections.Counter(x for w in want for x in w[3])
    best = collections.Counter()
    for (_, y), n in counts.items():
        best[y] = max(best[y], n)
    assert len(got) == len(texts)
    for i, (n_a, n_b, groups, links) in enumerate(want):
        r = got[i]
        assert (r["n_a"], r["n_b"], r["groups"], r["n_links"]) == (n_a, n_b, groups, len(links)), texts[i]
        assert r["n_groups"] == (groups.count(";") + 1 if groups else 0)
        assert (r["n_best"], r["count_sum"]) == (sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links))


def test_alignment_equals_the_bytes_of_whole_texts(spark):
    rng = random.Random(3)
    alphabet = "ab \n\t.é😀一'1 ́▁  "
    _check_alignment(spark, [*MIXED, *("".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40))) for _ in range(300))])


def test_alignment_of_the_small_table_and_of_none(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    _check_alignment(spark, texts, docs.orderBy("doc_id"))
    assert alignment.align_tokens(docs.limit(0), FIRST, SECOND).count() == 0
    assert alignment.score_links(alignment.align_tokens(docs.limit(0), FIRST, SECOND), 32000).count() == 0


def test_alignment_query_hashes_groups(spark):
    from visitline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in QUERIES["op11_token_alignment"](spark, sf).collect()}
    for (i, text), (_, _, groups, _) in zip(docs, _aligned_by_force([t for _, t in docs])):
        assert got[i]["groups_sha256"] == (hashlib.sha256(groups.encode()).hexdigest() if groups else "")
