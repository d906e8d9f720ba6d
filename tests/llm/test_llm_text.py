"""Quality rules, mixing, secrets, word pieces and chat formatting on small frames."""

import hashlib
import random
import re

import pytest

from clickpath.llm import chat_template, fair_mix, randomness, rule_cascade, wordpiece

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, kept string"
CLEAN = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(60))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, CLEAN, "en", "a", 1, 7, "x"), (1, CLEAN, "en", "a", 1, 7, "x"), (2, None, None, None, None, 7, "x"),
            (3, "", "en", "b", 0, 7, "x"), (None, "### " * 40 + CLEAN, "en", None, 5, 7, "x"),
            (5, "Ha " * 200, "en", "a", 3, 7, "x"), (6, (CLEAN + "\n") * 3000, "en", "a", 3, 7, "x"),
            (7, CLEAN.upper(), "en", "b", 3, 7, "x")]
    return spark.createDataFrame(rows, DOCS)


def test_rules_keep_clean_and_reject_junk(docs):
    found = rule_cascade.judge(docs, ["doc_id"]).collect()
    assert len(found) == 8
    verdict = {(r.doc_id, r.n_words): r.kept for r in found}
    assert verdict == {(1, 60): True, (2, 0): False, (3, 0): False, (None, 100): False, (5, 200): False,
                       (6, 180000): False, (7, 60): False}


def test_rule_order_does_not_change_the_verdict():
    texts = [rule_cascade.Text(t) for t in (CLEAN, CLEAN.upper(), "### " + CLEAN, "a\n" * 30)]
    figures = [(r.name, 1.0 + i, 0.5) for i, r in enumerate(rule_cascade.RULES)]
    first = rule_cascade.cascade(rule_cascade.RULES, figures)
    assert first == list(rule_cascade.RULES)
    assert rule_cascade.cascade(rule_cascade.RULES, [(n, 1 / s, p) for n, s, p in figures]) == first[::-1]
    for t in texts:
        assert any(r.rejects(t) for r in first) == any(r.rejects(t) for r in first[::-1])


@pytest.mark.parametrize("seed", range(20))
def test_repeated_words_by_brute_force(seed):
    draw = random.Random(seed)
    words = [draw.choice("abc") for _ in range(draw.randint(0, 60))]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    assert rule_cascade.Text(" ".join(words)).n_repeat_words == len(covered)


def test_rules_on_an_empty_table(docs):
    assert rule_cascade.judge(docs.limit(0), ["doc_id"]).collect() == []


def test_mix_meets_targets_and_repeats(spark):
    rows = [(i, "w " * (1 + i % 7), ["hot", "a", None][0 if i % 3 else 1 + i % 2]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = fair_mix.mix(docs, block_rows=50).collect()
    again = fair_mix.mix(docs.repartition(7), block_rows=50).collect()
    key = lambda r: (r.doc_id, r.size)
    assert sorted(found, key=key) == sorted(again, key=key)
    source = {r[0]: r[2] for r in rows}
    taken, target, size = {}, {}, {}
    for r in found:
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        target[s], size[s] = r.target, r.source_size
        assert r.taken in (0, r.size, 2 * r.size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    for s in target:
        assert abs(taken[s] - target[s]) <= 8 and target[s] <= 2 * size[s]


def test_mix_of_nothing(docs):
    assert fair_mix.mix(docs.limit(0)).collect() == []
    null = [r for r in fair_mix.mix(docs).collect() if r.size == 0]
    assert len(null) == 2 and all(r.taken == 0 for r in null)


ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found)


def test_base_secrets_by_brute_force(spark):
    draw = random.Random(4)
    parts = ["token = \"abc\"", "Secret: abcdefgh1", "secret=token: abcdefghij", "AKIA" + "Z9" * 8, "AKIAB", "é😀",
             "0123456789abcdef" * 2, "deadbeef", "api_key='x/y+z_1.2-3='", "passwd=short", " ", "word"]
    texts = ["".join(draw.choice(parts) + draw.choice(["", " "]) for _ in range(draw.randint(0, 12))) for _ in range(150)]
    frame = spark.createDataFrame([*enumerate(texts), (900, None), (901, "")], "doc_id long, text string")
    for r in randomness.scan(randomness.with_matches(frame)).collect():
        text = (dict(enumerate(texts)).get(r.doc_id)) or ""
        want = plain_spans(text)
        said = ",".join(f"{k}:{a}:{e}" for a, _, e, k in want)
        assert r.base_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(w[1] == k for w in want) for k in range(3))
        assert set(filter(None, said.split(","))) <= set(r.spans.split(","))


def test_battery_tells_keys_from_words(spark):
    draw = random.Random(9)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    keys = ["".join(draw.choice(letters) for _ in range(40)) for _ in range(20)]
    words = ["thisisaverylongwordthatgoesonandon", "usr/local/share/python/lib/site/packages", "A" * 40,
             "abcdefghijklmnopqrstuvwxyzabcdefghijklmn"] * 10
    frame = spark.createDataFrame([(i, f"see {w} there") for i, w in enumerate(keys + words)], "doc_id long, text string")
    found = {r.doc_id: r.spans for r in randomness.scan(randomness.with_matches(frame)).collect()}
    assert sum("random:4:44" in found[i] for i in range(20)) >= 17
    assert not any(found[i] for i in range(20, 60))


def test_masking_keeps_rows_and_columns(spark, docs):
    text = "é token = abcdefgh1 and 0123456789abcdef0123456789abcdef end"
    extra = spark.createDataFrame([(9, text, "en", "a", len(text), 1, "y")], DOCS)
    out = randomness.mask_secrets(docs.union(extra))
    assert out.columns == docs.columns
    rows = out.collect()
    assert len(rows) == 9
    assert [r for r in rows if r.doc_id == 9][0].text == "é [secret] and [secret] end"
    assert [r for r in rows if r.doc_id == 9][0].n_chars == len("é [secret] and [secret] end")
    assert sum(r.text is None for r in rows) == 1


def greedy(word, start, inside):
    at = n = 0
    while at < len(word):
        known = start if at == 0 else inside
        end = next((e for e in range(len(word), at, -1) if word[at:e] in known), None)
        if end is None:
            return -1
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy_longest_match():
    draw = random.Random(3)
    some = lambda n: bytes(draw.choice(b"ab") for _ in range(n))
    for _ in range(300):
        pieces = [(some(draw.randint(1, 4)), draw.random() < 0.6) for _ in range(draw.randint(1, 8))]
        automaton = wordpiece.Automaton(pieces)
        start, inside = ({p for p, i in pieces if i == flag} for flag in (False, True))
        for _ in range(20):
            word = some(draw.randint(0, 9))
            assert automaton.count(word) == greedy(word, start, inside)


def test_token_counts(docs):
    found = wordpiece.token_counts(docs, [(b"word", False), (b"a", True), (b"b", True)], ["doc_id"]).collect()
    assert len(found) == 8
    one = next(r for r in found if r.doc_id == 1)
    assert (one.n_words, one.n_unknown) == (60, 56) and one.n_tokens == 56 + 4 * 3
    assert next(r for r in found if r.doc_id == 2)[1:] == (0, 0, 0)


def test_template_folds_constants_and_refuses_the_rest():
    nodes = chat_template.fold_nodes(chat_template.parse("a{{ 'b' + 'c' }}{% if 1 == 2 %}x{% else %}d{% endif %}"), {})
    assert nodes == [("put", ("const", "abc")), ("put", ("const", "d"))]
    for bad in ("{{ m.__class__() }}", "{{ a | nothing }}", "{% import os %}", "{{ 1 +", "{% for m in x %}"):
        with pytest.raises(chat_template.TemplateError):
            chat_template.compile_template(bad + ("}}" if bad.endswith("+") else ""), {})


def test_chat_round_trip(spark):
    draw = random.Random(6)
    bits = ["<|im_end|>", "<|im_start|>", "\n", "<|", "<||", "assistant", "é", "<", "|", "\\n", " "]
    rows = [(c, t, draw.choice(["user", "assistant", "sys\ntem", None]),
             draw.choice([None, "", "".join(draw.choice(bits) for _ in range(draw.randint(0, 9)))]))
            for c in (1, 2, None, 4) for t in range(draw.randint(1, 6))]
    rows += [(4, None, "assistant", "x" * 3_000), (4, None, "assistant", "x" * 3_000)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    parts = chat_template.formatted(frame, part_chars=50)
    found = {r.conv_id: r for r in chat_template.read_back(parts).collect()}
    assert set(found) == {1, 2, None, 4}
    for conv, r in found.items():
        own = sorted(((-1 if t is None else t), role or "", text or "") for c, t, role, text in rows if c == conv)
        turns = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert r.n_turns == len(own) and r.turns_sha256 == hashlib.sha256(turns.encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_rules_with_clashing_columns(spark):
    """A kept column with the name of a measure gives way to it."""
    rows = [(1, "one two three four five six seven eight nine ten eleven", "x", 7), (2, None, "y", 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words long")
    found = {r.doc_id: r for r in rule_cascade.judge(docs, docs.columns).collect()}
    assert found[1].n_words == 11 and found[2].n_words == 0
    assert found[1].kept is True and found[2].kept is False and found[1].text == rows[0][1]
