import hashlib
import pytest

from shareflow.llm import chat


def bos(turns):
    """A mark at the beginning, a system block where none is given, an end of another form."""
    given = turns[0][0] == "system"
    return "<s>" + ("" if given else "[SYS]be kind[/SYS]") + "".join(f"[{r}] {t} </s>" if r == "assistant" else f"[{r}]{t}\n" for r, t in turns)


def declared_bos(turns):
    return bos(turns)


declared_bos.context = 1


def last_only(turns):
    """Reasoning stays in the last turn only."""
    return "".join(f"[{r}]{t if k == len(turns) - 1 else t.replace('<think>', '')}" for k, (r, t) in enumerate(turns))


def conversations(spark, n, think=None):
    rows = [(1, 10 * k, "assistant" if k % 2 else "user", f"{'<think>' if k == think else ''}said {k} </s>") for k in range(n)]
    rows += [(2, 5, "assistant", ""), (2, 5, "user", "x"), (2, None, "system", "first")]
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), [(r, t) for c, _, r, t in rows if c == 1]


def of(segments, conv):
    return sorted((r for r in segments.collect() if r.conv_id == conv), key=lambda r: r.segment)


@pytest.mark.parametrize(("template", "n_segments"), [(bos, 1), (declared_bos, 4), (chat.turn_template, 4)])
def test_segments_make_the_whole_output(spark, monkeypatch, template, n_segments):
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 3)
    df, turns = conversations(spark, 11)
    segments = chat.format_segments(df, template)
    got = of(segments, 1)
    assert len(got) == n_segments and sum(r.n_turns for r in got) == 11
    assert "".join(r.formatted for r in got) == template(turns)
    pieces = [r.formatted[s:e] for r in got for s, e in zip(r.starts, r.ends, strict=True)]
    assert "".join(pieces) == template(turns) and len(pieces) == 11
    assert [p for k, p in enumerate(pieces) if f"said {k} " in p] == pieces
    assert [r.formatted[s:e] for r in got for s, e in zip(r.loss_starts, r.loss_ends, strict=True)] == [chat.escape(t) if template is chat.turn_template else t for r, t in turns if r == "assistant"]
    assert [x for r in got for x in r.roles] == [r for r, _ in turns] and all(r.rewritten_at is None for r in got)
    (short,) = of(segments, 2)
    assert short.formatted == template([("system", "first"), ("assistant", ""), ("user", "x")]) and short.roles == ["system", "assistant", "user"]
    assert [short.formatted[s:e] for s, e in zip(short.loss_starts, short.loss_ends, strict=True)] == [""]


@pytest.mark.parametrize("n", [3, 4, 6, 7])
def test_conversations_that_end_at_a_segment_border(spark, monkeypatch, n):
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 3)
    df, turns = conversations(spark, n)
    got = of(chat.format_segments(df, declared_bos), 1)
    assert [r.n_turns for r in got] == [3] * (n // 3) + [n % 3] * (n % 3 > 0) and "".join(r.formatted for r in got) == bos(turns)


def test_a_rewrite_over_a_segment_border_is_found(spark, monkeypatch):
    monkeypatch.setattr(chat, "SEGMENT_TURNS", 3)
    df, turns = conversations(spark, 8, think=5)
    (got,) = of(chat.format_segments(df, last_only), 1)
    assert got.formatted == last_only(turns) and got.rewritten_at == 6
    assert got.starts[:5] == [len(last_only(turns[:k])) for k in range(5)] and got.starts[5:] == [None] * 3 and len(got.loss_starts) == 2


def test_a_false_declaration_is_an_error(spark):
    def false_bos(turns):
        return bos(turns)

    def false_last(turns):
        return last_only(turns)

    false_bos.context, false_last.context = 0, 1
    df, _ = conversations(spark, 8, think=5)
    for template in (false_bos, false_last):
        with pytest.raises(Exception, match="the template's output depends on more turns|rewrites history"):
            chat.format_segments(df, template).collect()


def test_digests_of_other_templates_and_rewritten_conversations(spark):
    def im_start(turns):
        return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)

    def last_only(turns):  # keeps reasoning in the last turn only
        return "".join(f"[{r}]{t if k == len(turns) - 1 else t.replace('<think>', '')}" for k, (r, t) in enumerate(turns))

    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "<think>b"), (1, 2, "user", "c")], "conv_id long, turn long, role string, text string")
    read = lambda piece: tuple(piece.removeprefix("<|im_start|>").removesuffix("<|im_end|>\n").split("\n", 1))
    one = chat.digests(chat.format_segments(df, im_start), read, lambda x: x).first()
    assert (one.n_turns, one.loss_chars, one.loss_sha256) == (3, 8, hashlib.sha256(b"<think>b").hexdigest())
    two = chat.digests(chat.format_segments(df, last_only)).first()
    assert (two.n_turns, two.turns_sha256, two.loss_chars, two.loss_sha256) == (3, None, None, None) and two.formatted_chars == len("[user]a[assistant]b[user]c")
