import hashlib
import pickle
import random

import pytest
from hypothesis import given
from hypothesis import strategies as st

from aerogrid.llm.chat_format import TEMPLATE, format_pieces, format_report
from aerogrid.llm.chat_template import CONTROLS, CompiledTemplate, Const, If, Out, TemplateError, escape, unescape

pieces = st.lists(st.sampled_from([*CONTROLS, "\\", "<", "[", "/", "INST]", "s>", "é", "\n", "</", "<s", ""]), max_size=12).map("".join)


@given(pieces)
def test_escaping_is_reversible_and_leaves_no_control(text):
    assert unescape(escape(text)) == text
    assert not any(c in escape(text) for c in CONTROLS)


@given(pieces, pieces)
def test_no_control_arises_where_parts_meet(a, b):
    text, _ = CompiledTemplate(TEMPLATE).render([{"role": a, "text": b}, {"role": b, "text": a}])
    assert [text.count(c) for c in CONTROLS[:4]] == [2, 2, 0, 2]


def expected(rows):
    out = {}
    for conv, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        out.setdefault(conv, []).append((role or "", text or ""))
    result = []
    for conv, turns in out.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        whole = CompiledTemplate(TEMPLATE).render({"role": r, "text": t} for r, t in turns)
        assert "".join(unescape(whole[0][a:b]) for a, b in whole[1]) == loss
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        result.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(whole[0])))
    return sorted(result, key=repr)


def test_report_reads_turns_back(spark):
    rng = random.Random(3)
    parts = [*CONTROLS, "\\", "é", "\n", "<", " ok ", ""]
    rows = [(rng.choice([1, 2, 3, None]), rng.choice([0, 1, 2, None]), rng.choice(["user", "assistant", "system", None, "</s>", "assistant "]), "".join(rng.choices(parts, k=rng.randint(0, 6)))) for _ in range(80)]
    rows += [(9, 0, "assistant", None), (9, 0, "assistant", None), (10, 5, "user", "x" * 300_000), (11, 1, "user", "")] + [(12, i, "assistant", f"t{i}") for i in range(5000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS conv", "2 AS start")
    got = sorted((tuple(r) for r in format_report(table, CompiledTemplate(TEMPLATE)).collect()), key=repr)
    assert got == expected(rows)
    texts = {}
    for r in format_pieces(table, CompiledTemplate(TEMPLATE)).orderBy("conv", "start").collect():
        assert len(texts.setdefault(r.conv, "")) == r.start
        texts[r.conv] += r.piece
    assert {c: len(t) for c, t in texts.items()} == {e[0]: e[5] for e in got}
    assert format_report(table.where("false"), CompiledTemplate(TEMPLATE)).collect() == []


def render(source, *messages, **variables):
    return CompiledTemplate(source).render(messages, **variables)[0]


def test_language():
    m = [{"role": "user", "text": " a "}, {"role": "bot", "text": "b"}]
    assert render("{% for m in messages %}{{ loop.index }}{{ m['role'] | upper }}:{{ m.text | trim }}{% if not loop.last %};{% endif %}{% endfor %}", *m) == "1USER:a;2BOT:b"
    assert render("{% set x = 'p' + 1 %}{{ x }}{{ none }}{{ missing }}{{ 'y' if x == 'p1' and 'p' in x else 'n' }}") == "p1y"
    assert render("{% for m in messages %}{% if m.role == 'user' %}U{% elif loop.first or m.role != 'bot' %}F{% else %}B{% endif %}{% endfor %}", *m) == "UB"
    text, spans = CompiledTemplate("a{% generation %}b{{ 'c' }}{% endgeneration %}d{% generation %}{% endgeneration %}").render([])
    assert (text, spans) == ("abcd", [(1, 3)])
    assert render("{% for m in messages %}{{ loop.first }}{% endfor %}") == ""


def test_constants_are_folded():
    assert CompiledTemplate("a{{ 'b' | upper }}{% if 1 == 2 %}x{% elif true %}c{% else %}y{% endif %}{{ 1 + 2 }}").tree == (Out(Const("aBc3")),)
    assert isinstance(CompiledTemplate("{% if x %}a{% endif %}").tree[0], If)
    assert CompiledTemplate("{% if false %}a{% endif %}").tree == ()


@pytest.mark.parametrize(
    "source",
    ["{{ f(1) }}", "{{ ''.__class__.x() }}", "{{ a | nope }}", "{% for m in other %}{% endfor %}", "{% if a %}", "{% import os %}", "{{ a[1] }}", "{{ }}", "{% set loop = 1 %}", "{{ 1 2 }}", "{% for a in messages %}{% endfor %}{% for b in messages %}{% endfor %}"],
)
def test_what_is_not_allowed(source):
    with pytest.raises(TemplateError):
        CompiledTemplate(source)


def test_nothing_but_keys_can_be_reached():
    assert render("{{ messages.__class__ }}{{ x.__init__ }}{{ x.k.upper }}", x={"k": "v"}) == ""


def test_templates_travel_as_text():
    t = pickle.loads(pickle.dumps(CompiledTemplate(TEMPLATE)))
    assert t.render([{"role": "assistant", "text": "x"}]) == ("<|turn|>assistant<|text|>x</s>", [(25, 26)])
