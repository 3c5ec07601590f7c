"""Rule tables of relations and signals, and expressions that apply them to a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns that speak for each type of relation; the earlier type wins a tie, DEFAULT_RELATION without any.
RELATION_PATTERNS = {
    "BELONGS_TO": ("属于|隶属|归属|所在板块|所属板块", "主营.*行业|行业为|业务领域"),
    "PRODUCES": ("生产|制造|量产|出货|供货产品", "主营|主要产品|核心产品|主要从事"),
    "DIRECTLY_SUPPLIES_TO": ("直接供货|直接供应|已通过.*认证|认证.*供货", "已.*供货|批量供货|稳定供货|开始供货", "已向.*提供|已给.*供应"),
    "SUPPLIES_TO": ("供货|供应|是.*供应商|供应商", "供应链|上游.*供应|供应.*芯片"),
    "USES": ("采用|使用|应用.*技术|搭载", "使用.*技术路线|技术路线为"),
    "APPLIES_TO": ("应用于|应用场景|应用领域|适用", "可用于|面向|针对.*市场"),
    "COMPETES_WITH": ("竞争|竞争对手|对标|替代", "与.*竞争|取代|替代.*产品"),
    "STATE_TRANSITION": ("进入|从.*到|跃迁|升级", "从.*阶段|阶段跃迁|状态转移", "量产爬坡|产能释放|规模量产|中试|送样"),
    "DISCLOSES": ("披露|公告|说明|发布", "在.*披露|公告称|表示"),
    "CATALYZES": ("催化|推动|加速|促进", "带动|拉动|赋能"),
    "CONSTRAINS": ("受限于|取决于|瓶颈|约束", "受限|产能.*不足|产能.*紧张"),
}
DEFAULT_RELATION = "SUPPLIES_TO"
# Kind of signal -> (type of its subject, polarity, least strength, keywords in order of preference).
SIGNALS = {
    "mass_production": ("product", "positive", 84, ("规模量产", "大规模量产", "批量交付", "规模化交付", "批量供货", "量产", "达产")),
    "capacity": ("sector", "positive", 78, ("扩产", "新增产能", "投产", "产能爬坡", "项目开工")),
    "policy": ("policy", "positive", 76, ("十五五", "政策", "规划", "补贴", "国产替代", "监管")),
    "capex": ("sector", "positive", 80, ("资本开支", "capex", "算力投入", "设备采购")),
    "earnings": ("company", "positive", 82, ("业绩预告", "业绩预增", "超预期", "扭亏", "扣非净利润", "毛利率", "净利润")),
    "order": ("company", "positive", 82, ("签订重大合同", "重大合同", "中标", "大额订单", "长期合同", "客户导入", "战略合作", "订单")),
    "risk": ("company", "risk", 76, ("监管函", "减值准备", "客户集中度", "风险", "诉讼", "处罚", "减值", "停产", "订单延期")),
}
# Words that strengthen a signal, by how much each; sources that are trusted more; and the two confidences.
MARKERS, MARKER = ("显著", "大规模", "首次", "超预期", "重大", "大幅"), 4
TRUSTED, CONFIDENCE = ("announcement", "evidence"), (0.78, 0.68)
# Subjects of kinds whose subject is a theme.
THEMES = {"capex": "资本开支", "risk": "风险事件"}
POLICY, COMPUTING = "政策主题", ("算力", "算力基础设施")


def relation_type(text: Column) -> Column:
    """The type with most patterns in a text."""
    scored = F.array(*[F.struct(sum((F.coalesce(text, F.lit("")).rlike(p).cast("int") for p in patterns), F.lit(0)).alias("n"), F.lit(-k).alias("order"), F.lit(name).alias("type")) for k, (name, patterns) in enumerate(RELATION_PATTERNS.items())])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["type"]).otherwise(DEFAULT_RELATION)


def rule_table() -> Column:
    """array<struct<kind, subject_type, polarity, base, keywords>>"""
    return F.array(*[
        F.struct(F.lit(kind).alias("kind"), F.lit(subject).alias("subject_type"), F.lit(polarity).alias("polarity"), F.lit(base).alias("base"), F.array(*[F.lit(w) for w in words]).alias("keywords"))
        for kind, (subject, polarity, base, words) in SIGNALS.items()
    ])


def holds(text: Column, word: Column) -> Column:
    return F.contains(text, word) | F.contains(F.lower(text), F.lower(word))


def sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, "[。！？；;\n]"), F.trim), lambda s: s != "")


def strength(sentence: Column, base: Column) -> Column:
    return F.least(F.lit(100), base + sum((F.contains(sentence, F.lit(m)).cast("int") * MARKER for m in MARKERS), F.lit(0)))


def subject_name(kind: Column, title: Column, sentence: Column) -> Column:
    """The theme of a kind that has one, else the title's beginning, else the sentence's."""
    out = F.when(kind == "policy", F.when(F.contains(sentence, F.lit(COMPUTING[0])), COMPUTING[1]).otherwise(POLICY))
    for k, theme in THEMES.items():
        out = out.when(kind == k, theme)
    return out.otherwise(F.substring(F.coalesce(F.nullif(title, F.lit("")), sentence), 1, 24))


# The older six kinds of signal and their keywords; words of sentiment, and of strength.
OLDER_SIGNALS = {
    "product_expansion": ("扩产", "新增产能", "新建", "投产", "量产", "产品线扩张", "新工厂", "产业园", "项目开工", "产能释放", "产能爬坡"),
    "supply_chain": ("供应商", "原材料", "采购", "供应链", "战略合作", "上下游", "产业链整合", "独家供应", "供应商准入"),
    "policy_impact": ("政策", "监管", "补贴", "税收优惠", "行业规划", "双碳", "碳中和", "碳达峰", "专精特新", "国产替代", "进口替代"),
    "management_change": ("董事长", "总经理", "高管", "换届", "离职", "任命", "管理层", "核心技术人员", "首席", "cto", "ceo"),
    "financial_highlight": ("营收增长", "净利润", "毛利率", "订单", "合同", "回款", "现金流", "业绩预增", "扭亏", "大幅增长", "超预期", "符合预期", "不及预期", "低于预期"),
    "risk_warning": ("风险", "诉讼", "处罚", "商誉减值", "存货减值", "应收账款", "债务", "资金紧张", "停产", "召回"),
}
POSITIVE = ("增长", "突破", "创新", "领先", "扩张", "提升", "大增", "超预期", "大幅", "显著", "明显", "持续", "战略", "重大", "强劲", "开门红")
NEGATIVE = ("下降", "亏损", "减少", "下滑", "不及预期", "低于预期", "风险", "诉讼", "处罚", "停产", "召回", "商誉减值", "大幅下跌")
STRONG_WORDS, WEAK_WORDS = ("大幅", "显著", "明显", "持续", "战略", "重大", "强劲", "首次"), ("略有", "小幅", "轻微", "尝试", "试产", "小批量")
SHORTEST_SENTENCE, CONTENT, SAME = 6, 200, 50


def held(text: Column, words: tuple[str, ...]) -> Column:
    """How many of the words a text holds."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def gap(sentence: Column) -> Column:
    """positive, negative or neutral, by the words of sentiment that it holds."""
    p, n = held(sentence, POSITIVE), held(sentence, NEGATIVE)
    return F.when(p > n, "positive").when(n > p, "negative").otherwise("neutral")


def strength_label(sentence: Column) -> Column:
    return F.when(held(sentence, STRONG_WORDS) > 0, "strong").when(held(sentence, WEAK_WORDS) > 0, "weak").otherwise("medium")


def sentiment(text: Column) -> Column:
    """-1 to 1: positive less negative words over both, to three decimals; 0 without any."""
    p, n = held(text, POSITIVE), held(text, NEGATIVE)
    return F.when(p + n == 0, 0.0).otherwise(F.round((p - n) / (p + n), 3))
