import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notelink.llm import chat

PARTS = [*chat.CONTROL, "\\", "<", "[", "|>", "x", "\n", "é😀", "</s", "INST]", "<|im", " "]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_escape_is_reversible_and_leaves_no_control_string(parts):
    text = "".join(parts)
    e = chat.escape(text)
    assert chat.unescape(e) == text and not any(c in e for c in chat.CONTROL)


def test_expressions_statements_and_folding():
    run = lambda t, **v: chat.compile_template(t)(v)[0]
    assert run("a{{ 'b' ~ 1 ~ true ~ none }}c{{ x }}", x=2) == "ab1truec2"
    assert run("{% for m in ms %}{{ loop.index }}{{ m.a.b }}{% if not loop.last %},{% endif %}{% endfor %}", ms=[{"a": {"b": "p"}}, {}]) == "1p,2"
    assert run("{% if a == 'x' or b and not c %}1{% elif b != 2 %}2{% else %}3{% endif %}", a="y", b=2, c=True) == "3"
    assert run("{{ (' p ' | trim | upper) ~ \"q\\n\" }}") == "Pq\n"
    assert chat.parse("{% if 1 == 1 %}a{% else %}{{ x }}{% endif %}{{ 'b' ~ 'c' }}") == [("text", "abc")]
    assert chat.parse("{% if false %}a{% elif x %}b{% elif true %}c{% else %}d{% endif %}") == [
        ("if", [(("path", ["x"]), [("text", "b")])], [("text", "c")])]
    text, spans = chat.compile_template("é{% generation %}{{ a }}{% endgeneration %}-{% generation %}{% endgeneration %}")({"a": "日本"})
    assert text == "é日本-" and spans == [(1, 3), (4, 4)]


@pytest.mark.parametrize("bad", ["{{ a", "{% for x %}{% endfor %}", "{% if a %}", "{{ f(1) }}", "{{ a.__class__ }}", "{{ a | nope }}", "{{ }}",
                                 "{{ 1 2 }}", "{% endif %}", "{% include 'x' %}", "{{ a[0] }}", "{% if a %}{% endfor %}", "{{ import }}{% x %}", "{{ a + }}"])
def test_what_is_not_in_the_language_is_refused(bad):
    if bad == "{{ a":
        assert chat.compile_template(bad)({})[0] == bad  # no tag: text
    else:
        with pytest.raises(chat.TemplateError):
            chat.parse(bad)


def test_python_objects_are_out_of_reach():
    class Secret:
        key = "k"

    assert chat.compile_template("{{ s.key }}|{{ t.upper }}")({"s": Secret(), "t": "x"})[0] == "|"


def test_round_trip_of_conversations_and_defined_cases(spark):
    rng = random.Random(2)
    rows = []
    for c in range(30):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", "assistant", "system", "<|im_sep|>", "a\nb"]), "".join(rng.choice(PARTS) for _ in range(rng.randint(0, 9)))))
    rows += [(50, 0, None, None), (50, 0, "assistant", "b"), (50, 0, "assistant", "a"), (50, None, "user", "first"), (50, 0, "assistant", "a"),
             (None, 1, "user", "x"), (51, 1, "assistant", "y" * 100_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_chat(chat.format_chat(chat.conversations(df))).collect()}
    assert len(got) == len({r[0] for r in rows})
    for c, r in got.items():
        own = sorted([x for x in rows if x[0] == c], key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in own]
        assert r.loss_texts == [x[3] or "" for x in own if x[2] == "assistant"]
        assert [chat.unescape(r.formatted[s.start:s.end]) for s in r.loss_spans] == r.loss_texts
    assert chat.format_chat(chat.conversations(df.limit(0))).count() == 0
    with pytest.raises(chat.TemplateError):
        chat.format_chat(chat.conversations(df), "{{ f(1) }}")
