"""Resource rows of our own: sentences, rules, word lists. Small fixed tables, joined by broadcast."""

from __future__ import annotations

#: Sentences of which the synthetic Arabic corpus is made.
SENTENCES = (
    "ذهبت الى السوق صباحا ثم عدت الى البيت.",
    "هذة المدرسه كبيرة جدا ، وفيها ثلاث أيام للنشاط.",
    "هل وصلت الرسالة ? نعم, وصلت أمس; شكرا لك.",
    "كان كان الطقس جميلا في المدينة المدينة القديمة.",
    "جمـــيل أن نلتقي هنا مـرة أخرى !",
    "اريد چاي وگهوة الآن لو سمحت.",
    "شلونك اليوم وشكو ماكو عندكم بالبيت؟",
    "ازيك عامل ايه دلوقتي يا صديقي؟",
    "كيفك شو بدك تعمل هلق بعد العمل؟",
    "اشتريت خمسة سيارات وسبع كتب من المعرض.",
    "انشاء الله نلتقي غدا في المكتبة.",
    "المسؤول عن المشروع قدم تقريرا مفصلا عن النتائج المتوقعة.",
    "قال المسئول إن القرار نهائي ولا رجعة فيه.",
    "بلغ العدد 125 ثم ارتفع إلى ١٣٠ خلال شهر.",
    "بالتالي يجب علينا أن نعمل بجد واجتهاد من أجل تحقيق الأهداف المرجوة في أقرب وقت ممكن.",
    "لاكن الوقت ضيق، والعمل كثير؛ فلنبدأ الان: خطوة خطوة.",
    "تم تنفيذ الخطة وفقا للمعايير المعتمدة رسميا.",
    "رائع! هذا انجاز مذهل! أنا سعيد جدا!",
    "تشير البيانات إلى زيادة بنسبة 15% في الإنتاج.",
    "للتواصل: info@mail.example.com أو زوروا https://www.example.org/help.",
    "الهاتف +964 770 123 4567 متاح دائما #دعم @فريق.",
    "وذلك بالاضافه الى ما سبق ذكره في الفقرة الأولى.",
    "كتب الطالب الدرس الان، وقرأ المعلم النص قراءة متأنية.",
    "نرجو منكم التكرم بالموافقة على الطلب المرفق.",
    "أنتم مدعوون للمشاركة معنا، فلا تترددوا أبدا.",
    "من الممكن أن يتم القيام بدراسة الموضوع لاحقا.",
    "الكتاب `x = 1` مثال، والنص <b>مهم</b> جدا، كما قال المسئول.",
    "ظهرت النتيجه متاخره، ولكنها كانت مرضية للجميع.",
)
#: Literal rules: id, pattern, suggestion, category, severity, confidence, priority, autofix, takes prefixes, profile.
RULES = (
    ("HAMZA_TO", "الى", "إلى", "spelling", "error", 0.99, 80, True, True, "all"),
    ("THIS_FEM", "هذة", "هذه", "spelling", "error", 0.99, 80, True, True, "all"),
    ("SCHOOL_TAA", "المدرسه", "المدرسة", "spelling", "error", 0.99, 80, True, True, "all"),
    ("RESULT_TAA", "النتيجه", "النتيجة", "spelling", "error", 0.99, 80, True, True, "all"),
    ("LATE_TAA", "متاخره", "متأخرة", "spelling", "error", 0.97, 80, True, False, "all"),
    ("BUT_ALEF", "لاكن", "لكن", "spelling", "error", 0.99, 80, True, True, "all"),
    ("GOD_WILLING", "انشاء الله", "إن شاء الله", "spelling", "error", 0.99, 80, True, False, "all"),
    ("ADDITION", "بالاضافه الى", "بالإضافة إلى", "spelling", "error", 0.98, 80, True, False, "all"),
    ("ADDITION_ONE", "بالاضافه", "بالإضافة", "spelling", "error", 0.99, 80, True, False, "all"),
    ("ACHIEVEMENT", "انجاز", "إنجاز", "spelling", "error", 0.95, 80, True, True, "all"),
    ("WANT_HAMZA", "اريد", "أريد", "spelling", "error", 0.96, 80, True, True, "all"),
    ("PASSIVE_DONE", "تم تنفيذ", "نفذ", "style", "hint", 0.72, 20, False, False, "formal"),
    ("DOING_OF", "القيام بدراسة", "دراسة", "style", "hint", 0.72, 20, False, False, "academic"),
    ("CONSEQUENTLY", "بالتالي", "لذلك", "style", "hint", 0.72, 20, False, False, "academic"),
    ("IQ_HOW", "شلونك", "كيف حالك", "dialect", "hint", 0.72, 30, False, False, "all"),
    ("EG_NOW", "دلوقتي", "الآن", "dialect", "hint", 0.72, 30, False, False, "all"),
    ("LEV_NOW", "هلق", "الآن", "dialect", "hint", 0.72, 30, False, False, "all"),
)
PREFIXES = ("و", "ف", "ب", "ك", "ل", "ال")
MASCULINE_NUMERALS = (("ثلاثة", "ثلاث"), ("أربعة", "أربع"), ("خمسة", "خمس"), ("ستة", "ست"), ("سبعة", "سبع"), ("ثمانية", "ثماني"), ("تسعة", "تسع"), ("عشرة", "عشر"))
FEMININE_COUNTED = ("سيارات", "مدارس", "سنوات", "ساعات", "صفحات", "مرات", "كلمات", "طالبات", "مدن", "قصص")
MASCULINE_COUNTED = ("أيام", "كتب", "أشهر", "رجال", "دروس", "أطفال", "أقسام", "بيوت", "أبواب", "مشاريع")
#: Group, canonical form, variant.
VARIANTS = (("responsible", "المسؤول"), ("responsible", "المسئول"), ("city", "المدينة"), ("now", "الآن"), ("now", "الان"))
#: Form, dialect, weight.
DIALECT_FORMS = (
    ("شلونك", "iraqi", 1.4), ("شكو", "iraqi", 1.2), ("ماكو", "iraqi", 1.2), ("چاي", "iraqi", 0.8), ("ازيك", "egyptian", 1.4), ("دلوقتي", "egyptian", 1.3),
    ("ايه", "egyptian", 0.9), ("كيفك", "levantine", 1.1), ("شو", "levantine", 1.0), ("بدك", "levantine", 1.2), ("هلق", "levantine", 1.3), ("كيفك", "gulf", 0.4),
)
#: Tone, word, weight.
TONE_WORDS = (
    ("formal", "نرجو", 0.6), ("formal", "وفقا", 0.5), ("formal", "رسميا", 0.5), ("formal", "التكرم", 0.4), ("objective", "البيانات", 0.6), ("objective", "تقريرا", 0.4),
    ("objective", "النتائج", 0.3), ("conversational", "شكرا", 0.4), ("conversational", "صديقي", 0.5), ("assertive", "يجب", 0.6), ("assertive", "نهائي", 0.4), ("persuasive", "مدعوون", 0.4),
)
#: Wordy phrase, shorter one; applied in this order.
CONCISE = (("من الممكن أن", "قد"), ("في أقرب وقت ممكن", "قريبا"), ("من أجل", "لأجل"), ("يتم القيام بدراسة", "يدرس"), ("بجد واجتهاد", "بجد"))
#: Sentences of which the corpus for grammar and style is made.
GRAMMAR_SENTENCES = (
    "هذا المدرسة الكبيرة في المدينة القديمة.",
    "وصل الطالبة الجديد إلى المكتبة.",
    "لم يكتبون الرسالة ولن يدرسون الكتاب.",
    "كتاب الطالب في المكتبة الكبيرة.",
    "كتب المعلم الرسالة ثم وصلت الطالبة.",
    "قام المعلم بدراسة المشروع، قامت بتنفيذ المشروع الجديد.",
    "قاموا بدراسة الكتاب والمشروع؛ وقام بتحقيق الأهداف.",
    "يصل المعلم إلى المدرسة ولا يصل الطالب.",
    "يكتب الطالب الدرس ثم لا يكتب الرسالة.",
    "هذه الكتاب جديد، وتلك الطالب كبير.",
    "ذهب المعلم إلى الطالبان في المدرسة.",
    "إلى المعلمون كتبت الطالبة رسالة جديدة.",
    "نرجو التكرم بالموافقة رسميا. وفقا للتقرير نرجو الرد. شكرا يا صديقي.",
    "العدد 250 والنسبة 15% جدا جدا، سعيد جدا.",
    "الدرس الان، والوقت الان ضيق جدا. سعيد جدا اليوم.",
    "رجع مرة أخرى مجددا وعاد إلى الوراء.",
    "يدرس الطالب في المكتبة 3 ساعات kept open ولا يدرس في البيت.",
    "درس الطالب الكتاب في البيت. هذا درس جديد.",
    "في درس الطالب. لم درس الكتاب.",
    "تحقيق الأهداف وتنفيذ المشروع ثم دراسة الرسالة وتحقيق النتائج.",
)
#: Lemma, root, template, part of speech, gender, frequency.
LEXEMES = (
    ("كتاب", "كتب", "فعال", "noun", "masculine", 900), ("طالب", "طلب", "فاعل", "noun", "masculine", 700), ("طالبة", "طلب", "فاعلة", "noun", "feminine", 500),
    ("مدرسة", "درس", "مفعلة", "noun", "feminine", 650), ("معلم", "علم", "مفعل", "noun", "masculine", 600), ("رسالة", "رسل", "فعالة", "noun", "feminine", 400),
    ("مكتبة", "كتب", "مفعلة", "noun", "feminine", 300), ("مشروع", "شرع", "مفعول", "noun", "masculine", 350), ("مدينة", "مدن", "فعيلة", "noun", "feminine", 450),
    ("درس", "درس", "فعل", "noun", "masculine", 380), ("دراسة", "درس", "فعالة", "verbal_noun", "feminine", 320), ("تنفيذ", "نفذ", "تفعيل", "verbal_noun", "masculine", 250),
    ("تحقيق", "حقق", "تفعيل", "verbal_noun", "masculine", 240), ("كبير", "كبر", "فعيل", "adjective", "masculine", 500), ("كبيرة", "كبر", "فعيلة", "adjective", "feminine", 480),
    ("جديد", "جدد", "فعيل", "adjective", "masculine", 520), ("جديدة", "جدد", "فعيلة", "adjective", "feminine", 510), ("قديمة", "قدم", "فعيلة", "adjective", "feminine", 310),
    ("كتب", "كتب", "فعل", "verb", "masculine", 800), ("درس", "درس", "فعل", "verb", "masculine", 420), ("وصل", "وصل", "فعل", "verb", "masculine", 560), ("ذهب", "ذهب", "فعل", "verb", "masculine", 610),
)
INTRANSITIVE = ("وصل", "ذهب")
#: Prefix of a nominal, whether it makes it definite, the preposition in it.
NOMINAL_PREFIXES = (("", False, ""), ("ال", True, ""), ("و", False, ""), ("وال", True, ""), ("ب", False, "ب"), ("بال", True, "ب"), ("ل", False, "ل"), ("لل", True, "ل"))
#: Ending of a nominal, its number, the genders it is for, what a final ة turns into before it.
NOMINAL_ENDINGS = (
    ("", "singular", "masculine", "ة"), ("", "singular", "feminine", "ة"), ("ان", "dual", "masculine", "ت"), ("ان", "dual", "feminine", "ت"),
    ("ين", "dual", "masculine", "ت"), ("ين", "dual", "feminine", "ت"), ("ون", "plural", "masculine", ""), ("ات", "plural", "feminine", ""),
)
#: Prefix and ending of a verb, gender, number, tense.
VERB_AFFIXES = (
    ("", "", "masculine", "singular", "past"), ("", "ت", "feminine", "singular", "past"), ("", "وا", "masculine", "plural", "past"), ("ي", "", "masculine", "singular", "present"),
    ("ت", "", "feminine", "singular", "present"), ("ي", "ون", "masculine", "plural", "present"), ("ي", "وا", "masculine", "plural", "shortened"),
)
#: Template, part of speech, confidence. The letters ف ع ل stand for the root's.
TEMPLATES = (
    ("فاعل", "noun", 0.62), ("مفعول", "noun", 0.64), ("مفعل", "noun", 0.5), ("مفعلة", "noun", 0.58), ("فعالة", "noun", 0.55), ("فعال", "noun", 0.5),
    ("فعيل", "adjective", 0.56), ("فعيلة", "adjective", 0.57), ("تفعيل", "verbal_noun", 0.66), ("فعل", "verb", 0.4), ("يفعل", "verb", 0.55), ("استفعال", "verbal_noun", 0.7),
)
STEM_PREFIXES = ("", "ال", "و", "ب", "ل", "وال", "بال")
STEM_ENDINGS = ("", "ات", "ون", "ين", "ها", "هم")
#: Demonstrative, gender, distance; all singular.
DEMONSTRATIVES = (("هذا", "masculine", "near"), ("هذه", "feminine", "near"), ("ذلك", "masculine", "far"), ("تلك", "feminine", "far"))
PREPOSITIONS = ("في", "من", "إلى", "على", "عن", "مع")
SUBJUNCTIVE_PARTICLES, JUSSIVE_PARTICLES = ("لن", "ولن", "كي", "حتى"), ("لم", "ولم", "لما")
#: Rules with patterns: id, pattern, suggestion ($n is a group), profile, text before, text after, exception, where that is looked for.
PATTERN_RULES = (
    ("PERCENT_SIGN", "([0-9]+)%", "$1٪", "all", "", "", "", ""),
    ("NOW_HAMZA", "الان", "الآن", "all", "(?:الدرس|الوقت) +", "", "", ""),
    ("NOW_BEFORE_COMMA", "الان", "الآن", "academic", "", "[،,]", "", ""),
    ("VERY_HEDGE", "جدا", "للغاية", "academic", "", "", "سعيد", "sentence"),
    ("VERY_AGAIN", "جدا جدا", "جدا", "all", "", "", "", ""),
    ("PHRASE_AGAIN", "مرة أخرى مجددا", "مجددا", "all", "", "", "", ""),
    ("PHRASE_BACK", "عاد\\s+إلى\\s+الوراء", "تراجع", "formal", "", "", "خطوة", "window"),
    ("TOKENS_READ", "في\\s+المكتبة(?:\\s+الكبيرة)?", "بالمكتبة", "all", "", "", "الكبيرة", "match"),
)
#: Rules whose matches block overlapping matches of another: id, pattern, blocked rule.
EXCEPTION_RULES = (("EXCEPT_HAPPY", "سعيد جدا", "VERY_HEDGE"), ("EXCEPT_PERCENT", "النسبة 15%", "PERCENT_SIGN"))
NEGATORS = ("لم", "لن", "لا")
TEMPORAL = ("أمس", "اليوم", "غدا", "لاحقا", "سابقا", "ثم", "بعد", "قبل")
AUXILIARIES = (("قام", "masculine"), ("قامت", "feminine"), ("قاموا", "plural"))
#: Verbal noun and the verb in its place: masculine, feminine, plural.
NOMINALIZATIONS = (("دراسة", "درس", "درست", "درسوا"), ("تنفيذ", "نفذ", "نفذت", "نفذوا"), ("تحقيق", "حقق", "حققت", "حققوا"))
CONNECTIVES = ("ثم", "أو", "لكن", "لأن", "حيث", "كما", "إذ")
#: Part of speech of a reading, what stands around it, weight.
SENSE_WEIGHTS = (
    ("verb", "bias", 0.1), ("noun", "bias", 0.2), ("adjective", "bias", 0.05), ("verbal_noun", "bias", 0.1), ("verb", "bos", 1.4), ("noun", "left_pos1:verb", 0.8), ("verb", "right_pos1:noun", 1.1),
    ("noun", "left1:في", 1.9), ("noun", "left1:هذا", 1.7), ("verb", "left1:لم", 2.1), ("noun", "right_pos1:adjective", 0.9), ("noun", "eos", 0.3), ("verb", "next_definite", 0.4), ("noun", "left_pos2:verb", 0.2),
)
#: Dialect word, its standard form, confidence.
MSA_FORMS = (
    ("شلونك", "كيف حالك", 0.92), ("شكو", "ماذا يوجد", 0.84), ("ماكو", "لا يوجد", 0.9), ("چاي", "شاي", 0.88), ("گهوة", "قهوة", 0.9), ("ازيك", "كيف حالك", 0.92), ("دلوقتي", "الآن", 0.94),
    ("ايه", "ماذا", 0.8), ("كيفك", "كيف حالك", 0.9), ("شو", "ماذا", 0.86), ("هلق", "الآن", 0.92), ("بدك", "تريد", 0.78),
)
#: Word of wanting before a verb, and the standard verb for it.
DESIRE_FORMS = (("بدي", "أريد"), ("بدك", "تريد"), ("بده", "يريد"), ("عايز", "أريد"), ("اريد", "أريد"))
#: Final mark by case for definite and indefinite words.
ENDINGS = (("genitive", "\u0650", "\u064d"), ("nominative", "\u064f", "\u064c"), ("subjunctive", "\u064e", "\u064e"), ("jussive", "\u0652", "\u0652"))
#: Replacements by rewriting mode, applied in this order within an edit budget.
REWRITES = {
    "formal": (("شكرا", "نشكركم"), ("نعم", "أجل"), ("جدا", "للغاية"), ("يا صديقي", "عزيزي القارئ")),
    "concise": CONCISE,
    "creative": (("ذهبت", "مضيت"), ("جميلا", "بديعا"), ("كبيرة", "فسيحة"), ("كثير", "وفير")),
    "academic": (("أنا سعيد", "من المرضي"), ("يجب", "ينبغي"), ("قال", "ذكر"), ("مذهل", "لافت")),
    "expand": ((". ", ". وعلاوة على ذلك، "), ("؛ ", "؛ وبناء على ذلك، ")),
}
