"""Fixed rule tables for titles, answers, chapters, facts and names of filings, and the expressions that read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.functions import rules

# Kinds of announcements by words of their titles, in the order of their priority.
ANNOUNCEMENT_TITLES = (
    ("half_report", ("半年度业绩预告", "半年度业绩快报", "半年度报告")),
    ("quarter_report", ("第一季度业绩预告", "第一季度业绩快报", "第一季度报告", "第三季度业绩预告", "第三季度业绩快报", "第三季度报告", "季度业绩预告", "季度业绩快报", "季度报告")),
    ("annual_report", ("年度业绩预告", "年度业绩快报", "年度报告")),
    ("research_survey", ("投资者关系活动", "投资者调研", "接待机构调研", "路演活动")),
    ("contract", ("中标签约", "合同签订", "合同签署", "重大合同", "中标", "合同公告", "中选", "重大订单", "签约")),
    ("ma_activity", ("重大资产重组",)),
    ("investment", ("对外投资", "股权收购", "收购资产", "投资设立", "增资")),
)

# Kinds of research reports by words of their titles, in the order of their priority.
REPORT_TITLES = (
    ("industry_chain", ("产业链", "供应链", "上下游")),
    ("industry", ("行业深度", "行业报告", "行业跟踪", "行业动态", "行业专题", "行业月报", "行业周报", "行业季报", "行业策略", "行业研究", "行业分析", "行业点评", "行业趋势", "行业展望", "行业图谱", "产业报告", "产业研究", "产业深度", "产业专题")),
    ("commodity", ("碳酸锂", "黄金", "原油", "大宗商品", "铜", "铝", "锂", "稀土", "煤炭", "钢铁", "水泥", "玻璃")),
    ("macro", ("宏观", "利率", "流动性", "社融", "通胀", "CPI", "PPI", "固收", "债券", "货币政策", "财政", "外贸")),
    ("special_topic", ("专题", "深度报告", "深度研究")),
    ("company", ("首次覆盖", "深度覆盖", "公司跟踪", "公司研究", "公司动态", "公司信息", "一季报", "半年报", "三季报", "年报", "业绩预告", "业绩快报", "业绩点评", "公司点评", "公司深度", "事件点评", "重大事项", "股权激励", "收购", "并购", "调研", "股东大会")),
)

# Answers that say nothing, what makes them worth keeping, and questions that need a number.
TEMPLATES = ("感谢您的关注", "谢谢您的关注", "感谢您对公司的关注", "感谢您对公司的关注和支持", "感谢您的关注和支持", "感谢您的关注和建议", "感谢您的关注，谢谢", "感谢您的关注！", "感谢您的关注。")
KEEPS_TEMPLATE = ("产能", "产量", "产品", "业务", "研发", "技术", "订单", "客户", "项目", "合作", "投资")
HOLDER_COUNTS = ("股东人数", "股东户数", "股东数量", "股东总户数", "股东总数")
SHORTEST_ANSWER, SHORT_QUESTION, GREETINGS = 15, 40, 2

# Subjects of questions and answers; a word of two subjects keeps its first place and takes the later subject.
SUBJECTS = (
    ("industry_chain", ("产业链", "供应链", "上下游", "供应端", "需求端", "供应商", "采购", "销售渠道", "经销商", "代理商")),
    ("industry", ("行业", "产业", "市场份额", "市场占有率", "竞争格局", "竞争对手", "竞争态势", "行业地位")),
    ("commodity", ("碳酸锂", "锂", "钴", "镍", "铜", "铝", "稀土", "煤炭", "钢铁", "水泥", "玻璃", "大宗商品", "原材料", "原料", "黄金", "白银", "原油", "石油", "天然气", "价格", "涨价", "跌价", "成本")),
    ("financial", ("业绩", "营收", "收入", "利润", "净利润", "毛利率", "ROE", "EPS", "每股收益", "估值", "PE", "PB", "股息", "分红", "派息", "送股", "转增", "资产负债", "负债率", "现金流", "应收账款", "季报", "半年报", "年报", "三季报", "一季报", "业绩预告", "业绩快报", "业绩公告", "营业额", "销售额", "订单", "在手订单")),
    ("production", ("产能", "产量", "扩产", "扩建", "投产", "量产", "开工率", "产能利用率", "利用率", "满产", "生产线", "工厂", "基地", "园区", "项目", "新产能", "新增产能", "规划产能")),
    ("technology", ("研发", "技术", "专利", "研发投入", "研发费用", "新产品", "新业务", "技术创新", "核心优势")),
    ("major_event", ("并购", "收购", "重组", "定增", "配股", "股权激励", "期权", "限制性股票", "战略", "合作", "项目", "海外", "出口", "进口", "海外业务")),
)
# Words of single technologies (subject industry_tech), by sector; callers may give their own.
TECH_SUBJECT = "industry_tech"
TECH_WORDS = (
    "芯片", "半导体", "晶圆", "封装", "制程", "光刻", "刻蚀", "SiC", "GaN", "IGBT", "MOSFET", "功率器件", "功率半导体", "第三代半导体", "化合物半导体", "模拟芯片", "MCU", "FPGA", "ASIC", "EDA", "IP核", "先进封装", "Chiplet", "SiP", "半导体设备", "半导体材料", "光刻机", "HBM", "存储芯片", "逻辑芯片", "SoC", "CIS",
    "光模块", "光通信", "CPO", "硅光", "相干", "DSP", "800G", "1.6T", "高速光模块", "光芯片", "激光器", "探测器", "WDM", "波分复用", "光连接", "光互连",
    "机器人", "人形机器人", "具身智能", "灵巧手", "减速器", "谐波", "RV减速器", "伺服", "伺服电机", "编码器", "力矩传感器", "六维力", "传感器", "执行器", "关节", "电机", "无框力矩", "空心杯", "滚珠丝杠", "行星滚柱丝杠", "丝杠", "运动控制", "机器视觉", "SLAM",
    "电池", "固态电池", "钠离子", "钠电池", "正极材料", "负极材料", "电解液", "隔膜", "磷酸铁锂", "磷酸锰铁锂", "三元材料", "前驱体", "复合集流体", "PET铜箔", "铜箔", "能量密度", "快充", "超充", "BMS", "热管理", "CTP", "CTC", "刀片电池", "4680",
    "新材料", "复合材料", "碳纤维", "陶瓷基", "高温合金", "钛合金", "镁合金", "超导", "石墨烯", "碳纳米管", "纳米材料", "特种材料", "功能材料", "涂层",
    "航天", "卫星", "火箭", "低轨", "星链", "星间链路", "遥感", "导航", "北斗", "雷达", "相控阵", "红外", "夜视", "制导", "惯性导航", "陀螺", "加速度计", "MEMS", "MEMS传感器", "军品", "军工", "导弹", "无人机", "舰船", "装甲", "火控", "电子对抗", "电磁", "SAR", "电子战", "数据链",
    "AI", "大模型", "算力", "算法", "深度学习", "训练", "推理", "GPU", "NPU", "AI芯片", "多模态", "AIGC", "生成式AI", "LLM", "大语言模型", "Transformer", "神经网络",
    "自动驾驶", "智能驾驶", "无人驾驶", "低空经济", "eVTOL", "飞行汽车",
)

# Greetings, words about the share price, and words of substance.
POLITE = ("请问", "你好", "请问一下", "请问董秘", "您好", "谢谢", "感谢", "辛苦了", "打扰了", "冒昧打扰", "请问贵公司", "能否告知", "能否介绍")
IRRELEVANT = ("股价", "股票", "市值", "建议", "希望", "希望公司", "希望管理层", "涨停", "跌停", "拉升", "炒作", "庄家", "主力", "利好", "利空")
SUBSTANCE = (
    "业绩", "收入", "利润", "净利润", "营收", "毛利率", "ROE", "订单", "在手订单", "现金流", "分红", "股息", "产能", "产量", "投产", "量产", "扩产", "开工率", "生产线", "产品", "销售", "市场", "客户", "供应商", "渠道", "份额", "市占率", "竞争", "行业", "产业", "产业链", "供应链", "上下游",
    "研发", "技术", "专利", "新产品", "新技术", "芯片", "半导体", "AI", "大模型", "机器人", "电池", "成本", "价格", "原材料", "并购", "收购", "重组", "定增", "股权激励", "合作", "项目", "战略", "海外", "出口", "业务", "布局", "进展", "规划", "目标",
)

# How answers begin and end, what puts a reader off to a filing, and what is a figure.
PREFIXES = ("尊敬的投资者，您好！", "尊敬的投资者，您好。", "尊敬的投资者您好！", "尊敬的投资者您好。", "投资者您好，", "投资者您好！", "投资者您好。", "您好，", "您好！", "尊敬的投资者：")
SUFFIXES = ("感谢您对公司的关注。", "感谢您对公司的关注！", "感谢您的关注。", "感谢您的关注！", "感谢关注。", "感谢关注！", "谢谢您的关注。", "谢谢您的关注！", "谢谢关注。", "谢谢关注！", "以上，感谢您对公司的关注。", "再次感谢您对公司的关注。")
DEFERRALS = ("以公告为准", "以公司公告为准", "详见公告", "参见公告", "查阅公告", "请以公告", "详见公司", "详见公司于", "将于公告中披露", "请关注公司公告", "请查阅公司在", "请投资者关注公司公告", "将在定期报告中", "会在定期报告", "信息披露义务", "及时信披", "及时披露", "将会按照相关规定")
FIGURES = (
    r"\d+\.?\d*\s*(亿|万|千)?\s*元", r"\d+\.?\d*\s*%", r"\d{4,}\s*(吨|户|GWh|MWh|万股|千瓦|平方米|公里|人)",
    r"(营收|净利润|毛利率|收入|利润|现金流|负债|资产|权益)\s*[为:：]?\s*\d+", r"(增长|下降|提升|降低|减少|增加)\s*\d+\.?\d*\s*[%百分点]", r"(同比增长|环比增长|同比下滑|环比下滑)\s*\d+\.?\d*\s*%",
)
LONG_ANSWER, EMPTY_CORE, SHORT_CORE = 300, 3, 50
TIERS = {"empty": 0, "defer": 0, "simple": 1, "data": 1, "complex": 2}

# What says that something is there, and that it isn't yet.
POSITIVE_MARKS = ("量产", "规模化", "大规模", "已突破", "已实现", "量产爬坡", "正式投产", "产能释放", "商业化", "规模交付", "批量供货")
NEGATIVE_MARKS = ("中试", "小批量", "研发中", "仍处", "未实现", "暂未", "试产", "样品阶段", "送样验证", "认证中", "未量产", "仍处于", "仍属", "尚未", "还未", "还在")

# Facts that words of a text state (all words of one of the groups), and values that no fact may have.
FACTS = (
    ("production", "mass_production_started", "量产", (("量产",),)),
    ("customer", "customer_introduction", "导入", (("导入",), ("进入供应链",))),
    ("order", "order_scheduled", "订单排产", (("订单", "排产"),)),
    ("financial", "earnings_below_expectation", "业绩不及预期", (("业绩不及预期",), ("低于预期",))),
)
FORBIDDEN_VALUES = ("mispriced", "expected_alpha", "buy", "sell", "recommendation_upgrade", "recommendation_downgrade")
FACT_CONFIDENCE, EXCERPT = 0.8, 500

# Metrics that a filing discloses, units near them (within so many characters), and what a metric needs.
METRICS = ("营业收入", "归属于上市公司股东的净利润", "归母净利润", "扣除非经常性损益后的净利润", "扣非净利润", "净利润", "毛利率", "基本每股收益")
UNITS, NEAR = ("亿元", "万元", "元", "%", "GWh", "MWh", "吨", "万股"), 180
METRIC_NUMBER = r"\d+[\.\d]*"
METRIC_UNIT = r"(%|亿元|万元|元|亿|万只|万辆|万吨|万台|万套|件|只|台|套|个|人|天|[0-9]+年|[0-9]+月|个百分点|比率|比例|增速|占比)"
OFFICIAL = ("announcement", "annual_report")

# Periods by words, in the order of their priority; the year, and how much of a text is looked at.
PERIODS = (("Q1", "quarterly", ("第一季度", "一季度")), ("Q2", "quarterly", ("第二季度", "二季度")), ("Q3", "quarterly", ("第三季度", "三季度")), ("Q4", "quarterly", ("第四季度", "四季度")), ("H1", "half-year", ("半年度", "半年报")), ("E", "forecast", ("预告", "预计")))
YEAR, SAMPLE = r"(20\d{2})\s*年", 1500

# Names that are no names, and names that stand for any company.
NOISE_NAMES = ("---", "--", "-", "###", "##", "#", "RELATES", "METRIC", "Entity", "Relation")
NOISE_MARKS = ("实体列表", "关系列表", "RELATES 关系", "METRIC 指标")
GENERIC = r"^(公司|本行|本公司|本集团|本企业|该企业|该(公|集)司|我们|我司|我公司)$"

# Who publishes research, and who doesn't whatever else the name says (looked for in lower case, so capitals never match).
BROKERS = ("证券", "研究所", "研究院", "研究中心", "咨询", "顾问", "评级", "评估")
NOT_BROKERS = ("WHO", "政府", "卫生部", "国家标准", "标准化技术委员会", "美国", "中国", "联合国", "欧盟", "央行", "财政部", "腾讯云", "阿里巴巴", "阿里云", "字节", "抖音")

# Lines that are no prose.
LINKS = r"https?://|www\.|@.+\.(com|cn|net|org|edu)|/api/v\d+|http\S+"
DISCLAIMER = r"(?i)(?:本报告|转载|版权|免责|风险提示|机构介绍|东北证券|中邮证券|东吴证券|国联证券|华泰证券|光大证券|中金公司|中信建投|中信证券|投资评级|投资建议|荐|维持|首次覆盖)[^\n]{0,30}?(?:仅供参考|不构成|禁止|联系|获取|报告来源)"
#: Thirty characters or more of which none is a letter, digit or ideograph.
GIBBERISH = r"^[^一-鿿\p{L}\p{N}_]{30,}$"

# Chapters by words of their headings, kinds that are always kept, and bodies that are kept whatever the heading.
SKIPPED_CHAPTERS = (
    "会计师事务所", "审计情况", "其他相关说明", "特此公告", "敬请", "广大投资者", "风险因素", "风险提示", "防范投资风险", "投资风险", "独立董事", "独立董事意见", "内部控制", "累计投票", "网络投票", "信息披露", "暂缓", "豁免", "募集资金", "关联交易", "担保", "对外担保", "提供担保", "董事会决议", "监事会决议",
    "股东大会决议", "董事会", "监事会", "股东大会", "通知", "制度", "管理办法", "实施细则", "提示性公告", "股票停牌", "延期", "补充公告", "更正公告", "审计报告", "法律意见书", "保荐机构", "核查意见", "备查文件", "会议通知", "网络投票说明", "授权委托书", "回执", "附件", "释义", "定义",
)
KEPT_CHAPTERS = (
    "业绩说明", "业绩变动", "业绩增长", "业绩下滑", "业绩亏损", "变动原因", "变动说明", "本次交易", "重组", "收购", "发行股份", "交易对方", "交易标的", "交易概述", "中标", "合同", "订单", "协议", "股权", "标的资产", "出资", "增资", "参股", "备考财务", "财务数据", "财务指标", "业务", "产品", "市场", "盈利", "营收",
    "营业收入", "营业成本", "收入", "研发", "投资者关系", "经营情况", "主营业务", "核心竞争力", "研发投入", "产能", "项目进展", "中标项目", "合同签订", "战略合作", "对外投资", "分红", "利润分配", "股本变动", "股东人数", "前十大股东", "回购", "增持", "减持",
)
ALWAYS_KEPT = ("investment", "ma_activity", "research_survey")
SUBSTANTIVE = "发行股份|购买资产|募集配套资金|股权|收购|重组|交易对方|标的资产|业绩下滑|业绩增长|业绩变动|业绩亏损|业绩驱动|业务|产品|市场|收入|研发|资产总额|资产净额|净利润|营业收入|营业成本"


def _any(text: Column, words) -> Column:
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(text, w))


def _strip(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\A\s+|\s+\z", "")


def subject_words(tech=TECH_WORDS) -> dict[str, str]:
    """word -> subject, in the order in which the words are looked for."""
    return {w: label for label, words in (*SUBJECTS, (TECH_SUBJECT, tech)) for w in words}


def title_class(title: Column, table) -> Column:
    """struct<doc_type, action> of a title: the first word that it holds decides; an empty title is unknown."""
    known = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(label).alias("label")) for label, words in table for w in words])
    hit = F.get(F.filter(known, lambda x: F.contains(title, x["word"])), F.lit(0))
    kind = F.when(F.coalesce(title, F.lit("")) == "", "unknown").otherwise(F.coalesce(hit["label"], F.lit("other")))
    return F.struct(kind.alias("doc_type"), F.when(kind.isin("unknown", "other"), "skip").otherwise("save").alias("action"))


def answer_filter(question: Column, answer: Column, tech=TECH_WORDS) -> Column:
    """struct<doc_type, action> of a question and its answer: the answer's quality first, then subjects, then small talk."""
    q, a = _strip(F.coalesce(question, F.lit(""))), _strip(F.coalesce(answer, F.lit("")))
    content = F.concat(q, F.lit(" "), a)
    known = F.array(*[F.struct(F.lit(w).alias("word"), F.lit(label).alias("label")) for w, label in subject_words(tech).items()])
    subject = F.get(F.filter(known, lambda x: F.contains(content, x["word"])), F.lit(0))["label"]
    thin = ~_any(content, SUBSTANCE)
    kind = F.when(F.coalesce(question, F.lit("")) == "", "unknown").when(a.isin("", "None", "nan"), "empty_answer").when(F.length(a) < SHORTEST_ANSWER, "short_answer")
    kind = kind.when(_any(q, HOLDER_COUNTS), F.when(a.rlike(r"\d"), "shareholder_count").otherwise("shareholder_no_data"))
    kind = kind.when(_any(a, TEMPLATES) & ~_any(a, KEEPS_TEMPLATE), "template_answer").when(subject.isNotNull(), subject)
    kind = kind.when(thin & (F.length(q) < SHORT_QUESTION) & (rules.hits(q, list(POLITE)) >= GREETINGS), "pure_greeting").when(thin & _any(content, IRRELEVANT), "low_value_irrelevant")
    kind = kind.when(thin & F.contains(q, F.lit("建议")), "pure_suggestion").when(thin, "low_value").otherwise("other")
    skipped = ("unknown", "empty_answer", "short_answer", "shareholder_no_data", "template_answer", "pure_greeting", "low_value_irrelevant", "pure_suggestion", "low_value")
    return F.struct(kind.alias("doc_type"), F.when(kind.isin(*skipped), "skip").otherwise("save").alias("action"))


def answer_core(answer: Column) -> Column:
    """An answer without one closing and one opening phrase, the first of each list that fits."""
    ends = F.get(F.filter(F.array(*[F.lit(s) for s in SUFFIXES]), lambda s: F.endswith(answer, s)), F.lit(0))
    cut = F.when(ends.isNull(), answer).otherwise(F.substring(answer, F.lit(1), F.length(answer) - F.length(ends)))
    begins = F.get(F.filter(F.array(*[F.lit(s) for s in PREFIXES]), lambda s: F.startswith(cut, s)), F.lit(0))
    return _strip(F.when(begins.isNull(), cut).otherwise(F.substring(cut, F.length(begins) + 1, F.length(cut))))


def answer_grade(answer: Column) -> Column:
    """struct<grade, tier>: empty, complex, defer, data or simple, and how deeply the answer is read (0 to 2)."""
    a = F.coalesce(answer, F.lit(""))
    core = answer_core(a)
    figure = F.exists(F.array(*[F.lit(p) for p in FIGURES]), lambda p: F.rlike(core, p))
    grade = F.when((_strip(a) == "") | (F.length(core) < EMPTY_CORE), "empty").when(F.length(a) >= LONG_ANSWER, "complex").when(_any(a, DEFERRALS) & (F.length(core) < SHORT_CORE), "defer").when(figure, "data").otherwise("simple")
    tier = F.coalesce(*[F.when(grade == g, n) for g, n in TIERS.items()])
    return F.struct(grade.alias("grade"), tier.alias("tier"))


def semantic_polarity(text: Column) -> Column:
    return rules.polarity(text, list(POSITIVE_MARKS), list(NEGATIVE_MARKS))


def stated_facts(text: Column) -> Column:
    """array<struct<dimension, state_value, trigger>>: the facts that a text states."""
    def states(groups) -> Column:
        out = F.lit(False)
        for words in groups:
            every = F.lit(True)
            for w in words:
                every = every & F.contains(text, F.lit(w))
            out = out | every
        return out

    found = [F.when(states(groups), F.struct(F.lit(d).alias("dimension"), F.lit(v).alias("state_value"), F.lit(t).alias("trigger"))) for d, v, t, groups in FACTS]
    return F.array_compact(F.array(*found))


def forbidden_value(dimension: Column, value: Column) -> Column:
    """The first forbidden value that a fact's dimension, else its value, holds; null for a fact that may stand."""
    held = lambda c: F.get(F.filter(F.array(*[F.lit(b) for b in FORBIDDEN_VALUES]), lambda b: F.contains(F.lower(F.coalesce(c, F.lit(""))), b)), F.lit(0))
    return F.coalesce(held(dimension), held(value))


def report_period(text: Column, source_name: Column, year_else: int) -> Column:
    """struct<period, period_type> of a filing: its year (or ``year_else``) and the first period word, else the year's actual figures."""
    sample = F.concat(F.coalesce(source_name, F.lit("")), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, SAMPLE))
    year = F.coalesce(F.nullif(F.regexp_extract(sample, YEAR, 1), F.lit("")), F.lit(str(year_else)))
    code, kind = F.lit("A"), F.lit("actual")
    for c, k, words in reversed(PERIODS):
        hit = _any(sample, words)
        code, kind = F.when(hit, c).otherwise(code), F.when(hit, k).otherwise(kind)
    return F.struct(F.concat(year, code).alias("period"), kind.alias("period_type"))


def unit_near(text: Column, term: Column) -> Column:
    """The first unit, by preference, within NEAR characters from a term's first place; null where there is none."""
    at = F.position(term, text)
    near = F.substring(text, at, F.lit(NEAR))
    return F.when(at > 0, F.get(F.filter(F.array(*[F.lit(u) for u in UNITS]), lambda u: F.contains(near, u)), F.lit(0)))


def metric_is_valid(description: Column) -> Column:
    """A metric's description needs a number and a unit."""
    d = F.coalesce(description, F.lit(""))
    return d.rlike(METRIC_NUMBER) & d.rlike(METRIC_UNIT)


def is_noise_name(name: Column) -> Column:
    """Empty names, markup, symbols only, headings and names of lists."""
    value = _strip(F.coalesce(name, F.lit("")))
    return (value == "") | value.isin(*NOISE_NAMES) | value.rlike(r"\A(?U:[\W_])+\z") | value.startswith("#") | _any(value, NOISE_MARKS)


def is_generic_name(name: Column) -> Column:
    return F.coalesce(name.rlike(GENERIC), F.lit(False))


def is_broker(name: Column) -> Column:
    """Whether a publisher is a broker or consultancy: names of others win."""
    n = F.coalesce(name, F.lit(""))
    return ~_any(F.lower(n), NOT_BROKERS) & _any(n, BROKERS)


def prose_lines(text: Column) -> Column:
    """A text's lines of prose: no blank lines, links, disclaimers, runs of symbols, or table lines (3 bars or more, over a quarter of the characters)."""

    def prose(raw: Column) -> Column:
        line = _strip(raw)
        bars = F.regexp_count(line, F.lit(r"\|"))
        return (line != "") & ~line.rlike(LINKS) & ~line.rlike(GIBBERISH) & ~line.rlike(DISCLAIMER) & ~((bars >= 3) & (bars > F.length(line) * 0.25))

    return F.array_join(F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), prose), "\n")


def chapter_action(heading: Column, body: Column, kind: Column) -> Column:
    """keep or skip: some kinds always stay; a heading's skip words, then its keep words; a body of substance stays anyway."""
    h, substance = F.coalesce(heading, F.lit("")), F.coalesce(body, F.lit("")).rlike(SUBSTANTIVE)
    return F.when(kind.isin(*ALWAYS_KEPT), "keep").when(_any(h, SKIPPED_CHAPTERS), F.when(substance, "keep").otherwise("skip")).when(_any(h, KEPT_CHAPTERS) | substance, "keep").otherwise("skip")
