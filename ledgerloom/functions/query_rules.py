"""Fixed rule tables for search queries and for compliance of texts, as regular expressions."""

# What a query can name, in the order in which it is looked for.
CODE = r"\d{6}\.(?:SH|SZ|BJ)"
COMPANY = r"[一-鿿]{2,6}(?:股份|集团|科技|电子|医药|能源|材料|智能|信息|通信|生物|电气|机械|汽车|化工|钢铁|矿业|建设|发展|投资|控股)"
INDUSTRIES = (
    "新能源", "半导体", "医药", "光伏", "锂电", "储能", "碳化硅", "人工智能", "AI", "芯片", "光通信", "光模块", "激光雷达", "CPO", "硅光", "功率半导体", "HBM", "先进封装", "机器人", "减速器", "传感器", "消费电子",
    "白酒", "食品饮料", "银行", "保险", "证券", "房地产", "军工", "航空航天", "新能源汽车", "充电桩", "风电", "核电", "5G", "物联网", "云计算", "大数据", "区块链", "数字货币", "稀土", "有色金属", "钢铁", "煤炭", "石油", "化工",
)
INDUSTRY = "|".join(INDUSTRIES)

# Two names joined, and a name before its possessive.
CONNECTOR = r"\s*(?:和|与|跟)\s*"
LEFT_NAME = r"[一-鿿]{2,6}$"
RIGHT_NAME = r"^([一-鿿]+?)(?:的|了|是|在|有|等|及|与|和|跟|[a-zA-Z0\d]|[，。！？：；]|$)"
OWNER = r"[一-鿿]{2,6}的"
PAIR = r"[一-鿿]{2,6}\s*(?:和|与|跟)\s*[一-鿿]{2,6}"

# Words by which a query's intent is told.
PATH_WORDS = r"路径|连接|从.*到|之间|和.*的关系|与.*的关系"
RELATION_WORDS = "关系|关联|联系|影响|供应商|客户|合作伙伴|竞争对手|上下游|产业链|供应链|传导"
STATE_WORDS = "行业|现状|趋势|概况|动态|发展|前景|展望|板块|领域|赛道|景气度"

# Query type -> intent and search strategy.
INTENTS = {
    "path_finding": ("find_path", "path"),
    "entity_relation": ("find_relations", "relation"),
    "industry_state": ("assess_state", "entity"),
    "entity_search": ("find_entity", "entity"),
}

# What a published text must not hold (with the name of the rule), what it may hold with a note, and what a hit becomes.
FORBIDDEN = (
    ("建议买入|建议卖出|建议建仓|建议清仓|建议减仓|建议加仓", "禁止买卖建议"),
    ("强烈推荐买入|强烈建议|买[入入]?|卖出?|做多|做空", "禁止买卖信号"),
    ("目标价|目标价位|目标市值|第一目标|第二目标", "禁止目标价"),
    ("仓位建议|配置比例|持仓比例|建仓比例", "禁止仓位建议"),
    ("必然上涨|必然下跌|一定会涨|一定会跌|保证收益", "禁止确定性预测"),
    ("内幕消息|未公开|庄家|主力控盘", "禁止内幕相关"),
)
WARNINGS = (
    ("可能上涨|可能下跌|有望|或将", "推测性措辞，正常"),
    ("风险提示|风险警示|风险因素", "正常风险提示"),
    ("不构成投资建议|仅供参考", "合规声明"),
)
REDACTED = "[已脱敏]"
