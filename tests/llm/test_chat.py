import hashlib

import pytest

from sievework.llm import chat


def test_parse_and_fold():
    t = chat.Template('{% if "a" == "a" and true %}x{{ "y" + "z" | upper }}{% else %}n{% endif %}{% if false %}q{% elif 1 in messages %}r{% endif %}')
    assert t.tree[0] == chat.Text("xyZ") and isinstance(t.tree[1], chat.If)
    assert t.render([]) == ("xyZ", [])
    assert chat.Template("{% if not (1 == 2) %}a{% endif %}b").tree == (chat.Text("ab"),)


def test_language():
    t = chat.Template("{% set sep = '|' %}{% for m in messages %}{{ loop.index0 }}{{ m[\"role\"] | trim | lower }}{% if not loop.last %}{{ sep }}{% endif %}{% generation %}{{ m.text }}{% endgeneration %}{% endfor %}")
    text, mask = t.render([{"role": " A ", "text": "xx"}, {"role": "B", "text": ""}])
    assert text == "0a|xx1b" and [text[a:b] for a, b in mask] == ["xx", ""]


@pytest.mark.parametrize("bad", ["{% for x in %}", "{% for x in y %}", "{{ a.__class__.__name__() }}", "{{ import os }}", "{% endif %}", "{{ 'x' | eval }}", "{{ a + }}", "{% if %}x{% endif %}", "{{ $ }}"])
def test_errors(bad):
    with pytest.raises(chat.TemplateError):
        chat.Template(bad)


def test_sandbox():
    for source in ("{{ messages.__class__ }}", "{{ missing }}", "{% for m in messages.0 %}x{% endfor %}", "{% for m in 'abc' %}x{% endfor %}", "{% for m in messages %}{{ m.keys }}{% endfor %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(source).render([{"role": "a", "text": "b"}])


def test_escape_round_trip():
    t = chat.Template()
    for text in ["", "\\", "\\\\", "\\0", "\\n", "n\\", chat.START, chat.END, "<" + chat.END + "\\" + chat.START, "<|im_<|im_end|>end|>", "\\" + chat.END * 3, "a\nb", "🙂\\1"]:
        for escape in (t.escape, t.line):
            assert t.unescape(escape(text)) == text
            assert chat.START not in escape(text) and chat.END not in escape(text)
        assert "\n" not in t.line(text)


def rows():
    out = [(1, 0, "user", "hi"), (1, 1, "assistant", "a<|im_end|>b"), (1, 2, "user", None), (1, 3, "assistant", "")]
    out += [(2, 1, "assistant", "second\\"), (2, 0, "sys\ntem", "first <|im_start|>"), (3, None, None, "x"), (3, 0, "assistant", "y"), (None, 0, "user", "q"), (4, 0, "assistant", "é🙂" * 20000), (5, 0, "assistant", "dup"), (5, 0, "assistant", "dup")]
    return out + [(10 + i // 3, i % 3, ["user", "assistant", "tool"][i % 3], f"text {i}") for i in range(300)]


def expected():
    by = {}
    for conv, turn, role, text in rows():
        by.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        whole = "".join(f"{r}\n{t}\n" for *_, r, t in turns)
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        out.append((conv, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows()], "conv_id long, turn long, role string, text string, mask string, start int")
    made = chat.format_conversations(df)
    got = chat.read_back(made).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == expected()
    one = made.where("conv_id = 1").first()
    assert one.text == "<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\na\\1b<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [one.text[m.start : m.stop] for m in one.mask] == ["a\\1b", ""]
    assert chat.read_back(chat.format_conversations(df.limit(0))).count() == 0


def test_filters_on_wrong_types_are_template_errors():
    for source in ("{{ 1 | upper }}", "{{ n | length }}", "{{ n + 'x' }}", "{{ 'x' in n }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(source).render([], n=3)
