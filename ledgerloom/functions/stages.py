"""Industry stages: the words that show them, which moves are possible, and stage expressions over one sentence."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stages in the order of a life cycle, and the words that show each.
STAGE_WORDS = {
    "LAB": ("理论研究", "基础研究", "概念验证", "原理探索", "论文阶段", "科学问题", "机理研究", "实验室研究", "可行性论证", "尚无商业化", "无商业化", "商业化前景不明", "仅停留在理论", "学术研究", "学术论文", "基础科学"),
    "RND": ("研发中", "研发阶段", "产品开发", "工艺研发", "技术攻关", "样机研制", "性能测试", "可靠性验证", "在研", "研制", "小试", "工艺定型", "配方研发", "持续研发", "研发早期", "早期研发", "研发初期"),
    "PILOT": ("中试", "小批量", "试产", "试制", "试生产", "送样验证", "客户认证", "产品定型", "工艺验证", "工程验证", "PVT", "导入量产", "转产", "可靠性认证", "样品阶段", "送样", "客户验证", "认证中", "产品认证", "小批量供货"),
    "EARLY_ADOPTION": ("头部客户", "重点客户", "首批交付", "商业化初期", "早期采用", "战略合作", "独家供货", "小批量量产", "初始产能", "客户拓展", "商业化验证", "定点", "取得订单", "开始供货"),
    "GROWTH": ("规模量产", "大规模量产", "产能释放", "规模交付", "订单饱满", "产能紧张", "满产满销", "营收增长", "规模效应", "市场份额提升", "进入头部客户", "批量商业化", "规模扩张"),
    "MATURITY": ("成熟", "稳定量产", "标准产品", "行业标准", "毛利率稳定", "行业龙头", "主导市场", "稳定供货", "成熟产品", "工艺稳定", "满产满销", "稳定增长", "市场份额稳定", "行业标准制定"),
    "DECLINE": ("需求下降", "产能过剩", "技术替代", "被淘汰", "市场萎缩", "毛利率下降", "竞争加剧", "营收下滑", "停产", "退出市场", "技术迭代", "新产品替代", "需求疲软", "去库存", "夕阳产业", "关停产线", "产能关停", "大幅亏损", "债务危机", "破产"),
}
# The moves from each stage; a stage's level; and which stage a text shows where two have as many words.
MOVES = {"LAB": ("RND", "PILOT"), "RND": ("LAB", "PILOT", "EARLY_ADOPTION"), "PILOT": ("RND", "EARLY_ADOPTION", "GROWTH"), "EARLY_ADOPTION": ("PILOT", "GROWTH", "MATURITY"), "GROWTH": ("EARLY_ADOPTION", "MATURITY", "DECLINE"), "MATURITY": ("GROWTH", "DECLINE"), "DECLINE": ("GROWTH", "MATURITY")}
LEVEL = {"LAB": 0, "RND": 1, "PILOT": 2, "EARLY_ADOPTION": 3, "GROWTH": 4, "MATURITY": 5, "DECLINE": -1}
RANK = {"LAB": 0, "RND": 1, "PILOT": 2, "EARLY_ADOPTION": 3, "MATURITY": 4, "GROWTH": 5, "DECLINE": -1}
# What says that a sentence tells of a move, of the present, or of the past.
STATED = "从.+?阶段.*?升级到.+?期|.+?已.*?进入?.+?期|.+?已.*?跃迁到.+?期|.+?已.*?升级到.+?期|.+?实现.*?进入?.+?期|从.+?向.+?跃迁|.+?向.+?迈进|.+?已处于.+?期|.+?目前处于.+?期|已实现规模量产|进入?产能爬坡|产能.*?释放|批量供货|规模交付|正式投产|产能过剩|需求下降|被替代|技术迭代|新产品替代"
VERBS = "从.+到|从.+进入|进入|升级|跃迁|迈向|过渡|转化|迈进"
PRESENT = "目前处于|处于|目前是|目前为"
PAST = "此前|之前|过去|曾经|去年|前年|上一年"


def word_stages() -> dict[str, str]:
    """word -> stage; a word of two stages shows the later one."""
    return {w: s for s in sorted(STAGE_WORDS, key=LEVEL.get) for w in STAGE_WORDS[s]}


def lookup(table: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(table.items())])


def shown_stages(sentence: Column) -> Column:
    """The stages whose words begin in a sentence, in the order of their places; at one place the one of the highest level."""
    known = word_stages()
    ordered = sorted(known, key=lambda w: -LEVEL[known[w]])
    # a look-ahead matches wherever a word begins, also inside another
    found = F.regexp_extract_all(sentence, F.lit(f"(?=({'|'.join(ordered)}))"), F.lit(1))
    return F.transform(found, lambda w: lookup(known)[w])


def text_stage(text: Column) -> Column:
    """The stage with most words in a text, by RANK on a tie; null without any."""
    scored = F.array(*[F.struct(sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0)).alias("n"), F.lit(RANK[s]).alias("rank"), F.lit(s).alias("stage")) for s, words in STAGE_WORDS.items()])
    best = F.array_max(scored)
    return F.when(best["n"] > 0, best["stage"])


def possible(before: Column, after: Column) -> Column:
    return (before == after) | F.array_contains(lookup_lists(MOVES)[before], after)


def lookup_lists(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(k), F.array(*[F.lit(x) for x in v])) for k, v in table.items()))


def direction(before: Column, after: Column) -> Column:
    """positive, negative or neutral; decline is left upwards only."""
    level = lookup(LEVEL)
    out_of_decline = F.when(level[after] > 0, "positive").otherwise("neutral")
    return F.when(before == after, "neutral").when(before == "DECLINE", out_of_decline).when(level[after] > level[before], "positive").otherwise("negative")
