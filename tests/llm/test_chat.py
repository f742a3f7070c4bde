import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from veilsift.llm.chat import TEMPLATE, TemplateError, compiled, digests, escaped, escaped_line, fold, format_conversations, parse, turns_of, unescaped


@given(st.text())
def test_escaping_is_reversible_and_leaves_no_control_string(text):
    assert unescaped(escaped(text)) == text
    assert "<" not in escaped(text) and "[" not in escaped(text)
    assert unescaped(escaped_line(text)) == text and "\n" not in escaped_line(text)


@given(st.lists(st.tuples(st.text(max_size=8), st.text(max_size=30))))
def test_turns_are_read_back(turns):
    out = compiled(TEMPLATE)({"messages": [{"role": r, "text": t} for r, t in turns]})
    assert turns_of(out.text()) == turns


def test_language():
    render = lambda s, **v: compiled(s)(v).text()
    assert render("{% set x = 1 + 2 * 3 %}{{ x }}") == "7"
    assert render("{% for m in ms %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[1, 2, 3]) == "1,2,3"
    assert render("{% if a == 1 %}one{% elif a in b %}in{% else %}no{% endif %}", a=2, b=[2]) == "in"
    assert render("a {%- if true %} b {% endif -%} c") == "a b c"
    assert render("{{ x.y['z'] | upper }}{{ q | default('-') }}{# no #}", x={"y": {"z": "v"}}) == "V-"
    assert render("{{ 'a' if false else 'b' ~ 1 }}") == "b1"
    assert render("{{ '%}' }}{{ \"}}\" }}") == "%}}}"


def test_constants_are_folded():
    tree = fold(parse("a{{ 1 + 1 }}b{% if 1 > 2 %}x{% else %}{{ 'y' | upper }}{% endif %}{{ z }}"))
    assert [(k.kind, k.value) for k in tree.kids] == [("const", "a2bY"), ("name", "z")]


@pytest.mark.parametrize("bad", ["{{ x", "{% for x %}{% endfor %}", "{% if a %}", "{{ a b }}", "{{ x | nope }}", "{% import os %}", "{{ 1 + }}", "{{ __class__ }}"])
def test_what_is_not_in_the_language_is_refused(bad):
    with pytest.raises(TemplateError):
        compiled(bad)


def test_values_are_reached_by_key_alone():
    with pytest.raises(TemplateError):
        compiled("{{ x.upper }}")({"x": object()})
    assert compiled("{{ x.keys }}")({"x": {}}).text() == ""
    with pytest.raises(TemplateError):
        compiled("{{ x * 1000 }}")({"x": "a"})


SCHEMA = "conv_id bigint, turn bigint, role string, text string, formatted string, starts string"
ROWS = [(1, 2, "assistant", "fine </s>[INST]"), (1, 1, "user", "hi <|im_end|>\n"), (2, 1, "assistant", None), (2, 1, "assistant", None), (3, None, None, "x"), (3, 0, "a\nb", "y|z"), (None, 0, "user", "null id"), (4, 0, "user", "long " * 50_000)]


def test_digests_against_a_plain_version(spark):
    got = {r["conv_id"]: r for r in digests(format_conversations(spark.createDataFrame([(*r, "f", "s") for r in ROWS], SCHEMA))).collect()}
    groups = {}
    for c, turn, role, text in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(groups)
    for c, turns in groups.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c]["n_turns"] == len(turns)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c]["loss_chars"], got[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_long_conversations_are_handed_on_by_size(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c}/{t} " * 40_000) for c in range(12) for t in range(3)]
    got = {r["conv_id"]: r for r in digests(format_conversations(spark.createDataFrame([(*r, "f", "s") for r in rows], SCHEMA).coalesce(1))).collect()}
    assert {c: (r["n_turns"], r["loss_chars"]) for c, r in got.items()} == {c: (3, len(f"{c}/1 ") * 40_000) for c in range(12)}


def test_spans_mark_assistant_texts(spark):
    out = compiled(TEMPLATE)({"messages": [{"role": "user", "text": "q"}, {"role": "assistant", "text": "a<b"}]})
    assert [unescaped(out.text()[a:b]) for a, b in out.spans] == ["a<b"]


def test_empty_table(spark):
    assert digests(format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0
