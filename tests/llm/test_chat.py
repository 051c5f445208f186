import hashlib
import random

import pytest

from kinfold.llm import chat


def render(source, **names):
    return "".join(s for s, _ in chat.compile_template(source)(**names))


def test_language():
    assert render("a{{ 1 }}{# no #}b{{ 'x' ~ 2 | string }}") == "a1bx2"
    assert render("{% for x in xs %}{{ loop.index }}{{ x.n }}{% if not loop.last %},{% endif %}{% endfor %}!", xs=iter([{"n": "p"}, {"n": "q"}])) == "1p,2q!"
    assert render("{% if a == 'u' and not b %}yes{% else %}no{% endif %}", a="u", b=None) == "yes"
    assert render(" {%- if true -%} x {%- endif -%} y") == "xy"
    assert render("{% set k = m['role'] | upper %}{{ k }}{{ m.none | default('-') }}{{ m.role | length }}", m={"role": "ab"}) == "AB-2"
    assert render("{{ '}}' }}{{ \"it's\" | replace('t', 'T') }}") == "}}iT's"
    assert render("{% for x in none %}a{% endfor %}") == ""


def test_sandbox():
    for bad in ("{{ x.__class__ }}", "{{ _x }}", "{{ x() }}", "{{ x | nope }}", "{% include 'a' %}", "{{ 1 +", "{% if x %}", "{{ }}", "{% for in x %}{% endfor %}", "{{ 'a' 'b' }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)
    with pytest.raises(chat.TemplateError):
        render("{{ x.real }}", x=1)
    with pytest.raises(chat.TemplateError):
        render("{{ x }}", x=object())


def test_folding():
    filters = chat._FILTERS | {"escape": lambda x: x}
    tree = chat.fold(chat.parse("a{{ 'b' ~ 1 }}{% if 1 == 1 %}c{% else %}{{ x }}{% endif %}{{ y }}{% if false and x %}d{% endif %}"), filters)
    assert tree == ("block", [("text", "ab1c"), ("out", ("name", "y"))])


def test_escape_round_trip():
    escape, unescape = chat.escaper()
    rng = random.Random(2)
    parts = [*chat.CONTROLS, "\\", ";", "0", "<", "/s>", "[", "INST]", " ", "x", "é"]
    for _ in range(3000):
        s = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        e = escape(s)
        assert unescape(e) == s and not any(c in e for c in chat.CONTROLS)


ROLES = ["user", "assistant", "system", "tool", None, ""]


def conversations(spark):
    rng = random.Random(4)
    parts = [*chat.CONTROLS, " ", "hello", "é🙂", "\\", "\n", "[", "</"]
    rows = []
    for conv in [*range(30), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, turn, rng.choice(ROLES), None if rng.random() < 0.1 else "".join(rng.choice(parts) for _ in range(rng.randint(0, 15))), "extra"))
    rows += [(77, None, "user", "no turn", "x"), (77, 1, "user", "tie b", "x"), (77, 1, "user", "tie a", "x"), (77, 1, "user", "tie a", "x"), (88, 0, "assistant", "long " * 40000, "x")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, part string")


@pytest.mark.parametrize("part_chars", [chat.PART, 50])
def test_digests_by_brute_force(spark, part_chars):
    rows, df = conversations(spark)
    parts = chat.format_conversations(df, part_chars=part_chars)
    got = {r.conv_id: r for r in chat.digest(parts).collect()}
    by = {}
    for c, t, r, x, _ in rows:
        by.setdefault(c, []).append((-1 if t is None else t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort()
        said = "".join(x for _, r, x in turns if r == "assistant")
        g = got[c]
        assert g.n_turns == len(turns) and g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
        assert g.loss_chars == len(said) and g.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        text = "".join(s for s, _ in chat.compile_template()(messages=[{"role": r, "text": x} for _, r, x in turns]))
        assert g.formatted_chars == len(text)
    assert chat.digest(chat.format_conversations(df.limit(0))).count() == 0
