"""Documents from templates: required fields, fields that are unknown or too long, tones, and the text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_LETTERS = 2000
#: By template its tones and its parts in order. A part is text, ``(field, placeholder)``, or
#: ``(field, None, before, after)`` of one that may be left out with what stands around it.
TEMPLATES: dict[str, tuple[tuple[str, ...], tuple]] = {
    "professional_email": (("formal", "friendly", "concise"), (
        "مرحبًا ", ("recipient", "[اسم المستلم]"), "،\n\nالموضوع: ", ("subject", "[موضوع الرسالة]"), "\n\n", ("context", "[السياق]"), "\n\nأرجو ", ("request", "[الإجراء المطلوب]"),
        ("deadline", None, " وأرجو إتمام ذلك بحلول ", ""), ".\n\nشكرًا لوقتكم، وأتطلع إلى ردكم.\n\nمع التقدير،\n", ("sender", "[اسم المرسل]"),
    )),
    "academic_abstract": (("academic", "concise"), (
        "الخلفية: ", ("background", "[الخلفية]"), ". الهدف: ", ("objective", "[الهدف]"), ". المنهج: ", ("method", "[المنهج]"), ". النتائج: ", ("results", "[النتائج الفعلية]"),
        ". الخلاصة: ", ("conclusion", "[الخلاصة والحدود]"), ".",
    )),
    "cover_letter": (("formal", "persuasive", "concise"), (
        "السادة في ", ("organization", "[اسم الجهة]"), " المحترمون،\n\nأتقدم لشغل منصب ", ("role", "[المسمى الوظيفي]"), ". ترتبط خبرتي بالدور من خلال: ", ("experience", "[الخبرة ذات الصلة]"),
        ".\n\nويحفزني للانضمام إليكم ", ("motivation", "[الدافع]"), ". يسعدني مناقشة كيفية توظيف هذه الخبرة لتحقيق أهداف الدور.\n\nمع التقدير،\n", ("sender", "[الاسم]"), ("contact", None, "\nبيانات التواصل: ", ""),
    )),
    "social_post": (("friendly", "persuasive", "creative"), (
        ("topic", "[افتتاحية الموضوع]"), "\n\n", ("value", "[القيمة التي سيحصل عليها القارئ]"), ("proof", None, "\n\nمثال: ", ""), "\n\n", ("call_to_action", "[دعوة واضحة للتفاعل]"), ("hashtags", None, "\n\n", ""),
    )),
    "meeting_summary": (("formal", "concise"), (
        "# ", ("title", "[عنوان الاجتماع]"), "\nالتاريخ: ", ("date", "[التاريخ]"), ("attendees", None, "\nالحضور: ", ""), "\n\n## القرارات\n", ("decisions", "[القرارات]"),
        "\n\n## الإجراءات\n", ("actions", "[الإجراء — المسؤول — الموعد]"), ("risks", None, "\n\nالمخاطر والعوائق:\n", ""),
    )),
    "executive_brief": (("formal", "academic", "persuasive"), (
        "# القرار المطلوب\n", ("decision", "[القرار المطلوب]"), "\n\n## السياق\n", ("context", "[السياق]"), "\n\n## الأدلة\n", ("evidence", "[الأدلة الموثقة]"), "\n\n## الخيارات\n", ("options", "[الخيارات والمفاضلات]"),
        "\n\n## التوصية\n", ("recommendation", "[التوصية والسبب]"), "\n\n## الخطوة التالية\n", ("next_step", "[المالك والموعد]"),
    )),
}


def fields(template: str) -> dict[str, bool]:
    """The fields of a template, and whether each is required."""
    return {part[0]: part[1] is not None for part in TEMPLATES[template][1] if not isinstance(part, str)}


def render(rows: DataFrame, template: str, tone: str = "formal", values: str = "values") -> DataFrame:
    """rows with ``letter`` and ``missing``: the template filled in from a map column of fields, and the required fields that are blank.

    A template or tone that there is not is an error, as are a field that the template does not have and one of more than 2,000 characters. A null map is an
    empty one; blank values count as missing, whose place a placeholder takes.
    """
    if tone not in TEMPLATES[template][0]:
        raise ValueError(f"no tone {tone} in {template}")
    known = fields(template)
    given = F.coalesce(F.col(values), F.create_map().cast("map<string,string>"))
    unknown = F.array_except(F.map_keys(given), F.array(*map(F.lit, known)))
    long = F.exists(F.map_values(given), lambda v: F.char_length(v) > MOST_LETTERS)
    value = lambda name: F.nullif(F.trim(given[name]), F.lit(""))

    def text(part) -> Column:
        if isinstance(part, str):
            return F.lit(part)
        if part[1] is None:
            return F.coalesce(F.concat(F.lit(part[2]), value(part[0]), F.lit(part[3])), F.lit(""))
        return F.coalesce(value(part[0]), F.lit(part[1]))

    whole = F.concat(*map(text, TEMPLATES[template][1]))
    sound = F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown fields: "), F.array_join(unknown, ", ")))).when(long, F.raise_error(F.lit("a field is too long"))).otherwise(whole)
    missing = F.filter(F.array(*(F.when(value(f).isNull(), F.lit(f)) for f, required in known.items() if required)), lambda x: x.isNotNull())
    return rows.select("*", sound.alias("letter"), missing.alias("missing"))
