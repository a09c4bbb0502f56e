"""Chat templates rendered byte for byte, and what is refused."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyforge.catalog.queries import INST_TEMPLATE, TURNS_TEMPLATE
from tallyforge.functions.templates import TemplateError, compiled, pieces

SYSTEM = [("system", "Be brief.")]
TALK = [("user", " Hello\n"), ("assistant", "Hi, é \"quoted\" "), ("user", "And\tnow? ")]
CONVERSATIONS = [SYSTEM + TALK, TALK, TALK[:1], SYSTEM, []]

HEADER_TEMPLATE = """{%- set today = strftime_now("%d %b %Y") -%}
{#- the date is said first -#}
{{- bos_token }}
{%- if messages[0]['role'] == 'system' %}
    {%- set system_message = messages[0]['content']|trim %}
    {%- set messages = messages[1:] %}
{%- else %}
    {%- set system_message = "" %}
{%- endif %}
{{- "<|start_header_id|>system<|end_header_id|>\\n\\n" }}
{%- if tools is not none and tools is defined %}
    {{- "Environment: tools\\n" }}
{%- endif %}
{{- "Today Date: " + today + "\\n\\n" }}
{{- system_message ~ "<|eot_id|>" }}
{%- for message in messages %}
    {%- if not (message.role == 'tool' or 'tool_calls' in message) %}
        {{- '<|start_header_id|>' + message['role'] + '<|end_header_id|>\\n\\n'+ message['content'] | trim + '<|eot_id|>' }}
    {%- endif %}
{%- endfor %}
{%- if add_generation_prompt %}
    {{- '<|start_header_id|>assistant<|end_header_id|>\\n\\n' }}
{%- endif %}
"""
LINES_TEMPLATE = """{% for message in messages %}
{% if message['role'] == 'user' %}
{{ '<|user|>\\n' + message['content'] + eos_token }}
{% elif message['role'] in ['system', 'tool'] %}
{{ '<|system|>\\n' + message['content'] + eos_token }}
{% else %}
{{ '<|assistant|>\\n'  + message['content'] + eos_token }}
{% endif %}
{% if loop.last and add_generation_prompt %}
{{ '<|assistant|>' }}
{% endif %}
{% endfor %}
"""
PARITY_TEMPLATE = "{{ bos_token }}{% for m in messages %}{% if (m['role'] == 'user') != (loop.index0 % 2 == 0) %}{{ raise_exception('Roles must alternate: ' + m['role']) }}{% endif %}{{ m.role|upper if loop.first else m.role }}={{ m['content']|length }};{% endfor %}"


def turns(c):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in c) + "<|im_start|>assistant\n"


def inst(c):
    system = c[0][1] if c and c[0][0] == "system" else None
    out = ""
    for i, (r, t) in enumerate(c[1:] if system is not None else c):
        t = f"<<SYS>>\n{system}\n<</SYS>>\n\n{t}" if i == 0 and system is not None else t
        out += f"<s>[INST] {t.strip()} [/INST]" if r == "user" else f" {t.strip()} </s>"
    return out


def header(c):
    system = c[0][1].strip() if c and c[0][0] == "system" else ""
    rest = c[1:] if c and c[0][0] == "system" else c
    head = f"<s><|start_header_id|>system<|end_header_id|>\n\nToday Date: 05 Mar 2026\n\n{system}<|eot_id|>"
    return head + "".join(f"<|start_header_id|>{r}<|end_header_id|>\n\n{t.strip()}<|eot_id|>" for r, t in rest) + "<|start_header_id|>assistant<|end_header_id|>\n\n"


def lines(c):
    out = ""
    for i, (r, t) in enumerate(c):
        out += f"<|{r}|>\n{t}</s>\n"
        if i == len(c) - 1:
            out += "<|assistant|>\n"
    return out


def render(spark, template, conversations, **names):
    rows = spark.createDataFrame([(i, [{"role": r, "content": t} for r, t in c]) for i, c in enumerate(conversations)], "i int, messages array<struct<role string, content string>>")
    return [r["p"] for r in rows.select("i", compiled(template, F.col("messages"), bos_token="<s>", eos_token="</s>", **names).alias("p")).orderBy("i").collect()]


@pytest.mark.parametrize(("template", "by_hand"), [(TURNS_TEMPLATE, turns), (INST_TEMPLATE, inst), (HEADER_TEMPLATE, header), (LINES_TEMPLATE, lines)])
def test_published_shapes(spark, template, by_hand):
    assert render(spark, template, CONVERSATIONS, date="2026-03-05") == [by_hand(c) for c in CONVERSATIONS]


def test_roles_that_do_not_alternate_are_an_error(spark):
    assert render(spark, PARITY_TEMPLATE, [TALK, []]) == ["<s>USER=7;assistant=15;user=9;", "<s>"]
    with pytest.raises(Exception, match="Roles must alternate: system"):
        render(spark, PARITY_TEMPLATE, [SYSTEM])


@pytest.mark.parametrize(("template", "want"), [
    ("{{ 'a~b' ~ 'true' }}{{ none }}", "a~btrue"), ("{% if enable_thinking is defined and enable_thinking is false %}x{% endif %}", "x"), ("{% if not enable_thinking %}off{% else %}on{% endif %}", "off"),
    ("{{ messages[-1].content.strip() }}", "And\tnow?"), ("{{ messages|length + 1 }}", "4"), ("{{ messages[0].content is string }}", "True"), ("{{ 'el' in messages[0].content and 'yes' }}", None),
    ("a {#- gone -#} b", "ab"), ("  {% if true %}\n  x\n  {% endif %}\ny", "  x\ny"), ("{{ x|default('d') }}{{ messages[0]['name'] is defined }}", "dFalse"),
    ("{{ messages[1].content|tojson }}", '"Hi, é \\"quoted\\" "'), ("{{ 'yes' if messages[0].content.startswith(' H') else 'no' }}", "yes"), ("{{ messages[0].content|replace('l', 'L')|trim }}", "HeLLo"),
])
def test_expressions(spark, template, want):
    if want is None:
        with pytest.raises(TemplateError):
            render(spark, template, [TALK], enable_thinking=False)
    else:
        assert render(spark, template, [TALK], enable_thinking=False) == [want]


@pytest.mark.parametrize("template", ["{% macro f() %}{% endmacro %}", "{{ messages }}", "{% for m in messages %}x", "{% for m in messages[::-1] %}{% endfor %}", "{{ f(1) }}", "{{ messages[0].content|wordcount }}", "{% set ns.x = 1 %}", "{{ a b }}"])
def test_what_is_not_understood_is_refused(spark, template):
    with pytest.raises(TemplateError):
        compiled(template, F.col("messages"))


def test_blanks_around_tags():
    assert pieces("a\n  {% if x %}\nb {{ y }}\n") == [("text", "a\n"), ("statement", "if x"), ("text", "b "), ("expression", " y "), ("text", "\n")]


def test_rendering_stays_in_built_in_functions(spark):
    rows = spark.createDataFrame([([{"role": "user", "content": "x"}],)], "messages array<struct<role string, content string>>")
    plan = rows.select(compiled(HEADER_TEMPLATE, F.col("messages"), date="2026-01-01"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
