"""The two-level filter of announcements: whole ones by title and contents page, sections by heading with inheritance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Titles that are skipped; headings that are skipped, else kept; and what speaks for substance.
SKIP_TITLES = ("管理制度", "管理办法", "工作细则", "工作规程", "审计报告", "审计意见", "内部控制评价", "内部控制审计", "业绩说明会纪要", "续租办公楼", "金融服务协议", "内幕信息知情人", "员工持股计划", "股权激励计划", "信息披露管理制度", "信息披露暂缓与豁免管理制度", "外部信息使用人管理制度", "董事局审计委员会")
SKIP_HEADINGS = ("会计师事务所", "其他相关说明", "特此公告", "敬请", "广大投资者", "风险因素", "防范投资风险", "投资风险", "独立董事", "内部控制", "累计投票", "网络投票", "信息披露", "暂缓", "豁免", "募集资金")
KEEP_HEADINGS = ("业绩", "变动原因", "变动说明", "本次交易", "重组", "收购", "发行股份", "交易对方", "交易标的", "交易概述", "中标", "合同", "订单", "协议", "股权", "标的资产", "出资", "增资", "参股", "备考财务", "财务数据", "业务", "产品", "市场", "盈利", "营收", "投资者关系")
SUBSTANCE = "发行股份|购买资产|募集配套资金|股权|收购|重组|交易对方|标的资产|业绩|盈利|净利润|营业收入|资产总额|资产净额"
CONTENTS, STOCK_CODE, AMOUNT, INVESTORS = r"目\s{1,3}录", r"证券代码[：:]\d+", r"\d+[万千百]元|\d+\.\d+[亿万]?元|\d+亿美元|\d+万美元", "投资者关系"
FIRST, SECOND = r"^([一二三四五六七八九十零]+)[、，,](.+)$", r"^（([一二三四五六七八九十]+)）"


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def heading_class(title: Column) -> Column:
    return F.when(_any(title, SKIP_HEADINGS), "skip").when(_any(title, KEEP_HEADINGS), "keep").otherwise("skip")


def sections(docs: DataFrame, id_col: str = "doc_id", text_col: str = "body") -> DataFrame:
    """(id, section, level, title, body, action): sections in order; one of the second level follows the first level's
    action, and a skipped one of the first level is kept if its own body has substance."""
    lines = docs.select(id_col, F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("i", "line")).withColumn("line", F.trim("line"))
    level = F.when(F.col("line").rlike(FIRST), 1).when(F.col("line").rlike(SECOND), 2)
    in_order = Window.partitionBy(id_col).orderBy("i")
    lines = lines.withColumn("level", level).withColumn("section", F.count("level").over(in_order)).filter("section > 0")
    body = F.array_join(F.transform(F.filter(F.array_sort(F.collect_list(F.struct("i", "level", "line"))), lambda x: x["level"].isNull()), lambda x: x["line"]), "\n")
    parts = lines.groupBy(id_col, "section").agg(F.max("level").alias("level"), F.max(F.when(F.col("level").isNotNull(), F.col("line"))).alias("title"), body.alias("body"))
    own = F.when(F.col("level") == 1, F.when(F.col("body").rlike(SUBSTANCE), "keep").otherwise(heading_class(F.col("title"))))
    above = F.last(own, ignorenulls=True).over(Window.partitionBy(id_col).orderBy("section"))
    return parts.withColumn("action", above).filter("action is not null")  # a second level before any first has no place


def filtered(docs: DataFrame, id_col: str = "doc_id", title_col: str = "title", text_col: str = "body") -> DataFrame:
    """(id, decision, reason, kept, skipped): process or skip for every row, and how many of its sections go which way."""
    counts = sections(docs, id_col, text_col).groupBy(id_col).agg(F.count_if(F.col("action") == "keep").alias("kept"), F.count_if(F.col("action") == "skip").alias("skipped"))
    rows = docs.select(id_col, F.coalesce(title_col, F.lit("")).alias("_title"), F.coalesce(text_col, F.lit("")).alias("_text")).join(counts, id_col, "left")
    none = F.col("kept").isNull()
    reason = F.when(_any(F.col("_title"), SKIP_TITLES), "title").when(F.trim("_text") == "", "empty").when(F.col("_text").rlike(CONTENTS), "contents")
    reason = reason.when(none & (F.col("_text").rlike(STOCK_CODE) | F.col("_text").rlike(AMOUNT)), "no_sections_substance").when(none & F.contains("_title", F.lit(INVESTORS)), "no_sections_investors").when(none, "no_sections")
    reason = reason.when(F.col("kept") == 0, "no_substantive_sections").otherwise("sections")
    out = rows.select(id_col, reason.alias("reason"), F.coalesce("kept", F.lit(0)).alias("kept"), F.coalesce("skipped", F.lit(0)).alias("skipped"))
    return out.withColumn("decision", F.when(F.col("reason").isin("sections", "no_sections_substance", "no_sections_investors"), "process").otherwise("skip"))
