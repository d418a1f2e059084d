"""Word lists and rules: the defaults of the operators, all of which take their own lists as well."""

from __future__ import annotations

# Results have to agree with these lists, item by item and in this order.
GREATER_CHINA_MARKERS = (
    "(CN)", "(CHN)", "(HK)", "(HKG)", "(MO)", "(MAC)", "(TW)", "(TWN)",
    "China", "Chinese Academy", "Chinese University", "Tsinghua", "Peking University",
    "Beijing University", "Zhejiang University", "Fudan University", "Shanghai Jiao Tong",
    "University of Science and Technology of China", "Harbin Institute of Technology",
    "Huazhong University", "Nanjing University", "Sun Yat-sen University",
    "Xi'an Jiaotong", "Tongji University", "Wuhan University", "Hong Kong",
    "Macau", "Macao", "Taiwan",
    "中国", "中华", "中科院", "中国科学院", "清华", "北京大学", "北大", "浙江大学",
    "复旦", "上海交通", "上海交大", "哈尔滨工业", "哈工大", "华中科技", "南京大学",
    "中山大学", "西安交通", "西安交大", "同济", "武汉大学", "香港", "澳门", "台湾",
)

# Profile, aliases in a query, words that speak for the domain, groups of words that speak against it.
DOMAIN_PROFILES = (
    ("农业",
     ("农业", "农学", "农业科学", "agriculture", "agricultural", "agronomy"),
     ("农业", "农学", "作物", "育种", "种质", "农艺", "植物科学", "植物遗传",
      "园艺", "土壤", "农机", "农业工程", "农业信息", "精准农业", "智慧农业",
      "畜牧", "养殖", "动物科学", "兽医", "水产", "林业", "粮食", "种子",
      "crop", "agriculture", "agricultural", "agronomy", "plant breeding",
      "plant science", "horticulture", "soil", "livestock", "animal science",
      "veterinary", "aquaculture", "forestry", "farming", "seed science"),
     (("精神病", "精神医学", "精神卫生", "精神分裂", "psychiatry", "psychiatric", "schizophrenia", "psychosis"),
      ("量子场论", "粒子物理", "高能物理", "quantum field theory", "particle physics", "high energy physics"),
      ("天体物理", "宇宙学", "黑洞", "astrophysics", "cosmology", "black hole"),
      ("心脏外科", "神经外科", "整形外科", "cardiac surgery", "neurosurgery", "plastic surgery"))),
    ("计算机",
     ("计算机", "信息技术", "人工智能", "computer science", "artificial intelligence"),
     ("计算机", "人工智能", "机器学习", "深度学习", "软件", "算法", "数据库",
      "网络安全", "计算机视觉", "自然语言处理", "信息检索", "机器人",
      "computer", "artificial intelligence", "machine learning", "deep learning",
      "software", "algorithm", "database", "cybersecurity", "computer vision",
      "natural language processing", "information retrieval", "robotics"),
     (("精神病", "精神医学", "精神分裂", "psychiatry", "schizophrenia"),
      ("作物育种", "种质资源", "畜牧育种", "crop breeding", "germplasm", "livestock breeding"),
      ("心脏外科", "神经外科", "cardiac surgery", "neurosurgery"))),
    ("物理",
     ("物理", "physics"),
     ("物理", "量子", "凝聚态", "粒子", "光学", "光子", "等离子体", "宇宙学",
      "引力", "材料物理", "physics", "quantum", "condensed matter", "particle",
      "optics", "photonics", "plasma", "cosmology", "gravitation"),
     (("精神病", "精神医学", "精神分裂", "psychiatry", "schizophrenia"),
      ("作物育种", "种质资源", "畜牧育种", "crop breeding", "germplasm", "livestock breeding"),
      ("临床肿瘤", "心脏外科", "神经外科", "clinical oncology", "cardiac surgery", "neurosurgery"))),
    ("医学",
     ("医学", "临床", "医疗", "medicine", "medical", "clinical"),
     ("医学", "临床", "疾病", "诊断", "治疗", "药物", "患者", "医院", "肿瘤",
      "心血管", "神经", "公共卫生", "medicine", "medical", "clinical", "disease",
      "diagnosis", "therapy", "drug", "patient", "hospital", "oncology"),
     (("量子场论", "粒子物理", "高能物理", "quantum field theory", "particle physics", "high energy physics"),
      ("天体物理", "宇宙学", "黑洞", "astrophysics", "cosmology", "black hole"),
      ("作物育种", "种质资源", "农机", "crop breeding", "germplasm", "agricultural machinery"))),
    ("生物",
     ("生物", "生命科学", "biology", "biological science", "life science"),
     ("生物", "生命科学", "基因", "蛋白质", "细胞", "微生物", "生态", "免疫",
      "神经生物", "生物信息", "组学", "biology", "biological", "gene", "genome",
      "protein", "cell", "microbiology", "ecology", "immunology", "bioinformatics"),
     (("量子场论", "粒子物理", "高能物理", "quantum field theory", "particle physics", "high energy physics"),
      ("天体物理", "宇宙学", "黑洞", "astrophysics", "cosmology", "black hole"),
      ("软件工程", "数据库系统", "计算机网络", "software engineering", "database systems", "computer networks"))),
)

# Words in a profile and the bonus they bring.
TITLE_BONUSES = (
    ("院士", 30), ("Academician", 30), ("National Academy", 30), ("Royal Society", 30),
    ("IEEE Fellow", 30), ("ACM Fellow", 30), ("AAAI Fellow", 30), ("Fellow", 20),
    ("图灵奖", 30), ("Turing Award", 30), ("诺贝尔", 30), ("Nobel", 30), ("菲尔兹", 30), ("Fields Medal", 30),
)

# Substrings that make a value missing, by predicate.
PENDING = "暂无|未知|公开信息|待补充|待核验|未核实|候选未核实|nan|None"
NOT_PUBLIC = "暂无|未知|公开信息|nan|None|未公开|无公开"
PLACEHOLDER = "暂无|未知|公开信息|nan|None"
NO_INFORMATION = "暂无公开信息"

# What counts as no value when it is the whole of a cell.
CELL_PLACEHOLDERS = ("", "-", "--", "/", "暂无", "暂无公开信息", "未知", "不详", "待补充", "nan", "none", "null")

# How far a source is trusted, by its domain.
LOW_TRUST_DOMAINS = (
    "wikipedia.org", "youtube.com", "youtu.be", "scribd.com", "radaris.com", "linkedin.com", "businessinsider.com",
    "leadiq.com", "wikihow.com", "movavi.io", "coursmos.com", "vedantu.com", "zoominfo.com", "rocketreach.co",
    "facebook.com", "instagram.com", "x.com", "twitter.com", "abebooks.com", "baike.baidu.com",
)
AUTHORITY_DOMAINS = (
    "openalex.org", "semanticscholar.org", "orcid.org", "nih.gov", "ncbi.nlm.nih.gov", "ieee.org", "acm.org",
    "nationalacademies.org", "royalsociety.org",
)

# Ordered, case-insensitive replacements of delivered text.
GLOSSARY = (
    (r"\bAssociate Professor\b", "副教授"), (r"\bAssistant Professor\b", "助理教授"), (r"\bEmeritus Professor\b", "荣休教授"),
    (r"\bVisiting Professor\b", "访问教授"), (r"\bProfessor\b", "教授"), (r"\bResearch Professor\b", "研究教授"),
    (r"\bPrincipal Investigator\b", "首席研究员"), (r"\bResearch Scientist\b", "研究科学家"), (r"\bSenior Scientist\b", "高级科学家"),
    (r"\bChief Scientist\b", "首席科学家"), (r"\bDirector\b", "主任"), (r"\bChair\b", "主任"), (r"\bDepartment of\b", "系"),
    (r"\bSchool of\b", "学院"), (r"\bCollege of\b", "学院"), (r"\bInstitute of\b", "研究所"), (r"\bResearch Center\b", "研究中心"),
    (r"\bResearch Centre\b", "研究中心"), (r"\bUniversity\b", "大学"), (r"\bNational Academy\b", "国家科学院"), (r"\bFellow\b", "会士"),
    (r"\baward\b", "奖项"), (r"\bawards\b", "奖项"), (r"\bresearch interests?\b", "研究方向"), (r"\bcollaboration\b", "合作"),
    (r"\bco-?author\b", "合著者"),
)

# Titles that evidence may show, and words that stand for work with partners in China.
TITLE_KEYWORDS = (
    "院士", "Academician", "National Academy", "Royal Society", "IEEE Fellow", "ACM Fellow", "AAAI Fellow", "Turing Award",
    "图灵奖", "Nobel", "诺贝尔", "Fields Medal", "菲尔兹", "CIGR Fellow", "CIGR member", "CIGR会员", "World Food Prize", "世界粮食奖",
)
COLLABORATION_TERMS = (
    "中国", "清华", "北京大学", "复旦", "上海交通", "浙江大学", "中国科学院", "Chinese", "China", "Tsinghua", "Peking University",
    "Fudan", "Shanghai Jiao Tong", "Zhejiang University", "Chinese Academy", "collaboration", "coauthor", "co-author", "合作", "合著",
)
INDEX_DOMAINS = ("openalex.org", "semanticscholar.org", "scholar.google", "pubmed.ncbi.nlm.nih.gov", "ncbi.nlm.nih.gov", "wikipedia.org")
PROFILE_HINTS = ("profile", "profiles", "people", "person", "persons", "staff", "faculty", "directory", "biography", "bio", "team", "our-people", "our-team")
WEAK_HINTS = ("search", "publication", "publications", "paper", "papers", "news", "event", "events", "project", "projects")
STRONG_SOURCE_HINTS = ("obituary", "memoriam", "news", "announcement", "tribute", "academy", "university", "institute", "society", "prize")

# Weight of each missing field in the gap score; others weigh 1.
GAP_WEIGHTS = {
    "homepage": 4, "org": 5, "position": 4, "achievements": 4, "collab": 4, "contact": 3, "career": 3, "education": 3, "basis": 3,
    "interests": 2, "h_raw": 2, "i10_raw": 2, "citations_raw": 2,
}

# Error sources by words in stage and message, in order.
ERROR_SOURCES = (
    (("llm", "模型中转", "研究员节点", "验证节点", "纠错节点", "文档压缩节点", "细分领域推荐节点"), "LLM 中转服务"),
    (("opencli",), "OpenCLI 浏览器工具"),
    (("个人主页", "主页访问", "http 主页"), "专家主页网站"),
    (("tavily",), "Tavily 搜索服务"),
    (("openalex",), "OpenAlex 数据库"),
    (("semantic scholar", "semanticscholar"), "Semantic Scholar 数据库"),
    (("excel", "xlsx", "工作簿", "批次读取", "表格解析"), "Excel 处理"),
    (("后台进程", "后台检索进程", "worker", "process"), "后台任务进程"),
)
ERROR_SOURCE_OTHER = "系统或网络环境"
ERROR_SOURCE_HOMEPAGE = "专家主页网站"
# Words in the message, the cause they tell, and what to do about it, in order; a pair of texts stands for
# (homepage source, other source).
ERROR_RULES = (
    (("sensitive words", "local:sensitive_words", "敏感词"),
     "中转服务的内容过滤规则误拦截了正常学术请求。",
     "系统会保留检查点；可重试该细分领域，若重复出现需扩充学术术语保护规则。"),
    (("not configured", "missing api key", "api key is missing", "缺少环境变量", "未配置"),
     "运行环境缺少该服务所需的地址、API Key 或其他配置。",
     "检查 .env 中对应服务的配置，修改后完整重启 Streamlit。"),
    (("401", "invalid_api_key", "incorrect api key", "authentication"),
     "身份验证失败，API Key 无效、过期，或与 API_BASE_URL 不属于同一平台。",
     "检查 .env 中对应服务的密钥和地址，修改后完整重启系统。"),
    (("winerror 10013", "socket access", "禁止的访问权限"),
     "本机防火墙、安全软件或受限运行环境禁止了外部网络连接。",
     "使用 start_streamlit_logged.cmd 在正常本地终端启动，并检查防火墙网络权限。"),
    (("403", "forbidden"),
     ("目标主页拒绝自动访问，通常是反爬虫、地区限制或访问权限限制。", "服务拒绝访问，当前密钥、账户或来源地址没有所需权限。"),
     ("系统将尝试 OpenCLI 或其他公开来源；单个主页失败不会终止整批任务。", "检查账户权限、额度与服务控制台中的访问限制。")),
    (("404", "not found"),
     "请求的资源不存在，可能是主页已迁移、接口路径错误或记录已删除。",
     "系统将改用其他公开来源；若为 API 地址，请核对服务提供方的接口路径。"),
    (("429", "rate limit", "too many requests", "限流", "冷却"),
     "服务触发调用频率或账户额度限制。",
     "等待服务冷却后仅重试未完成领域，并检查账户剩余额度和并发限制。"),
    (("500", "502", "503", "504", "bad gateway", "service unavailable"),
     "远端服务或中转网关返回服务器错误，当前服务暂时不可用。",
     "已完成批次不受影响；待服务恢复后仅重试未完成领域。"),
    (("context length", "maximum context", "too many tokens", "token limit"),
     "发送给模型的上下文超过该模型或中转服务允许的长度。",
     "减少单批证据文本或上传材料长度，再重试当前批次。"),
    (("name resolution", "getaddrinfo", "dns", "nodename nor servname"),
     "域名解析失败，当前网络无法把服务域名解析为可访问地址。",
     "检查本机 DNS、代理和网络连接，恢复后仅重试未完成领域。"),
    (("ssl", "certificate", "tls"),
     "HTTPS 证书校验或 TLS 握手失败。",
     "检查系统时间、代理证书和证书链；主页失败时系统会改用其他来源。"),
    (("connection refused", "actively refused", "连接被拒绝"),
     "目标服务端口拒绝连接，服务可能未启动或暂时不可用。",
     "确认对应服务或 OpenCLI Bridge 已启动，稍后重试未完成领域。"),
    (("connection reset", "remote disconnected", "connection aborted", "eof"),
     "连接已建立但被远端服务提前断开。",
     "通常属于服务波动或目标站限制；系统会保留已完成批次，可稍后续跑。"),
    (("connection error", "connecterror", "api connection", "连接失败"),
     "客户端未能与目标服务建立稳定连接。",
     "检查网络和对应服务状态；系统已保存断点，可稍后续跑。"),
    (("timeout", "timed out", "readtimeout", "connecttimeout", "超时"),
     "服务端或网络长时间未返回响应。",
     "系统不会丢失已完成批次；待服务恢复后仅重试未完成领域。"),
    (("permission denied", "winerror 32", "文件正在使用", "另一个程序正在使用"),
     "结果文件或运行目录被占用，系统无法读取或写入。",
     "关闭占用该 Excel 的程序，并确认当前用户对项目目录具有写入权限后重试。"),
    (("no space left", "disk full", "磁盘空间不足"),
     "磁盘剩余空间不足，无法保存检查点或 Excel 文件。",
     "释放项目所在磁盘空间后，从已保存的检查点继续运行。"),
    (("no module named", "modulenotfounderror", "importerror"),
     "运行环境缺少必要的 Python 依赖，或启动时使用了错误的虚拟环境。",
     "使用项目 .venv 启动，并根据 requirements.txt 补齐依赖。"),
    (("cancelled", "canceled", "keyboardinterrupt", "被取消"),
     "任务被用户、系统重启或运行环境主动取消。",
     "已完成批次仍保留在检查点中，可点击仅重试未完成领域继续。"),
    (("json", "markdown", "解析", "未生成有效", "未返回有效"),
     "服务返回了内容，但格式不符合系统要求，无法生成有效专家批次。",
     "重试该批次；若持续发生，需要检查模型输出格式和表格字段完整性。"),
)
ERROR_CAUSE_OTHER = "执行过程中出现未归类异常。"

ERROR_ACTION_OTHER = "查看下方技术详情和 worker.log；已完成批次与检查点不会被删除。"

# The items of a run's summary: name, column (none: all rows), value that is counted, remark.
RUN_SUMMARY = (
    ("最终输出专家数", None, None, "已完成清洗、去重和明确已故专家过滤"),
    ("姓名已验证", "name_check", "已验证", "通过多个公开来源交叉验证"),
    ("姓名待复核", "name_check", "待复核", "建议在正式使用前人工复核"),
    ("成功访问主页", "page_status", "是", "主页正文可访问且包含专家姓名"),
    ("OpenCLI成功访问主页", "page_method", "OpenCLI", "普通 HTTP 失败后由真实浏览器渲染读取成功"),
    ("主页访问失败", "page_status", "否", "包括 403、404、超时、SSL 或身份不匹配"),
    ("主页未尝试", "page_status", "未尝试", "受补全上限或缺少有效主页影响"),
    ("疑似已故待复核", "death_check", "疑似已故待复核", "未自动剔除，建议人工复核"),
    ("未发现死亡证据", "death_check", "未发现死亡证据", "独立网页检索未发现明确死亡证据"),
    ("生存状态核验未执行", "death_check", "未执行", "受配置、数量上限或缺少姓名影响"),
)

# Parts of sentences that evidence of each kind stands in.
EDUCATION_WORDS = r"博士|硕士|本科|毕业|学位|Ph\.?D|DPhil|MD|B\.?S\.?|M\.?S\.?|education|biography|received|earned|obtained"
#: (characters before, words, characters behind) of a part of a sentence that holds one of the words.
RESEARCH_PART = (60, r"research interests?|research focuses?|research areas?|研究兴趣|研究方向|主要研究|课题组研究|focuses on|works on|interested in", 220)
ACHIEVEMENT_PART = (
    80,
    r"award|honou?r|fellow|member of|academy|prize|medal|discovered|developed|led|published|citation|获奖|院士|会士|奖|发现|提出|领导|发表|引用",
    180,
)
CAREER_PART = (80, r"previously|formerly|served as|worked at|joined|appointed|曾任|历任|任职于|加入|受聘于|长期在", 180)
# What stands behind a label, up to the next one.
EDUCATION_LABEL = (
    r"(?:Education|教育背景|学历)\s*[:：-]\s*(.{6,160}?)"
    r"(?=\.\s+[A-Z][a-z]+\s+(?:received|won|was awarded|led|developed)|\s+(?:Research|Email|Phone|Contact|Awards?)\s*[:：-]|$)"
)
RESEARCH_LABEL = (
    r"(?:research interests?|research focuses?|research areas?|研究兴趣|研究方向|主要研究)\s*[:：-]\s*(.{8,220}?)"
    r"(?=\s+(?:Education|Email|Phone|Contact|Awards?)\s*[:：-]|$)"
)
RESEARCH_PREFIX = r"^(research interests?|research focuses?|research areas?|研究兴趣|研究方向|主要研究)\s*[:：-]?\s*"
CAREER_LABEL = (
    r"(?:Biography|Career|Professional Experience|工作经历|个人履历|职业经历)\s*[:：-]\s*(.{12,260}?)"
    r"(?=\s+(?:Education|Research|Email|Phone|Contact|Awards?)\s*[:：-]|$)"
)
# Words of page navigation, words that leave a collaboration unproved, words of a death.
NAVIGATION_TERMS = ("cookie", "privacy", "login", "menu", "copyright", "skip to", "search", "navigation")
UNPROVED_COLLABORATION = ("具体个人需逐篇核实", "未确认", "待核实", "中国作者", "中国团队", "等单位", "等中国", "合作网络", "相关活动", "相关论文", "国际合著")
DEATH_HAN_AFTER, DEATH_HAN_BEFORE = ("逝世", "去世", "辞世", "已故"), ("讣告", "悼念")
DEATH_AFTER, DEATH_BEFORE, DEATH_TITLE = ("passed away", "died", "is deceased", "was deceased"), ("death of", "obituary for"), ("obituary", "in memoriam")

# Parts of sentences that speak of a post, and of an institution.
POSITION_PART = (
    80,
    r"Professor|Associate Professor|Assistant Professor|Director|Chair|Principal Investigator|PI|Research Scientist|Group Leader"
    r"|教授|副教授|助理教授|研究员|首席科学家|主任|负责人|课题组长",
    80,
)
INSTITUTION_PART = (
    80,
    r"University|Institute|Laboratory|Lab|College|School|Center|Centre|Observatory|Hospital|大学|学院|研究所|实验室|中心|天文台|医院",
    80,
)

# A date or an age in what is said of a death, and what stands for a claim that is not upheld.
DEATH_DATE = r"(?:19|20)\d{2}|\b(?:jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)[a-z]*\b|\d{1,2}月\d{1,2}日|享年\s*\d+|aged?\s+\d+"
CLAIM_OPEN = "待核验"
CLAIM_REFUSED = "共享核验线索未通过补全分支身份闸门，不作为死亡结论：确认死亡需身份锁定、机构匹配、明确死亡日期，并至少具有两个独立的大学/政府权威来源。"

# Queries of the field that has sources of its own, and the sources: kind, name, URL, purpose, whether the page is read.
AGRICULTURE_QUERY = "农业|农学|作物|种植|养殖|粮食|农机|农业工程|农业信息|种质|agriculture|agricultural|crop|farming|food science"
SOURCE_RECORDS = (
    ("core", "OpenAlex", "https://openalex.org/", "作者身份、机构、论文、主题与引文指标交叉验证", False),
    ("core", "Semantic Scholar", "https://www.semanticscholar.org/", "作者身份和代表论文按需交叉验证", False),
    ("core", "Tavily 网页检索", "https://www.tavily.com/", "发现专家主页、奖项、合作新闻和公开网页证据", False),
    ("domain", "中国农业科学院农业资源与农业区划研究所杰出人才", "https://iarrp.caas.cn/rcdw1/jcrc/gjzrkxjjzdxmzcr/index.htm", "补充农业领域国内杰出人才候选", True),
    ("domain", "Stanford/Elsevier 全球前 2% 顶尖科学家数据集", "https://elsevier.digitalcommonsdata.com/datasets/btchxktzyw/8", "补充高影响力农业科学家候选与排名证据", True),
    ("domain", "世界粮食奖 2020-2026 获奖者", "https://www.worldfoodprize.org/en/laureates/20202026_laureates/", "补充农业与粮食领域最高奖项获得者", True),
    ("domain", "世界粮食奖 2025 农业食品领军人物", "https://www.worldfoodprize.org/index.cfm?nodeID=97060&audienceID=1", "补充农业食品领域领军人物", True),
    ("domain", "世界粮食奖 2024 农业食品领军人物", "https://www.worldfoodprize.org/en/nominations/top_agrifood_pioneers/2024_top_agrifood_pioneers_list/", "补充农业食品领域领军人物", True),
    ("domain", "CIGR 信息技术分会成员", "https://www.cigr.org/SectionVII", "补充现代农业信息技术与农业工程专家", True),
    ("domain", "CIGR 成员与治理机构名录", "https://www.cigr.org/membersxgoverning-bodies-overview", "交叉验证 CIGR 成员身份与任职", True),
)

# Words of a failed connection, and of the service that it is about.
CONNECTION_WORDS = ("connection error", "connecttimeout", "readtimeout", "timed out", "连接失败", "连接超时", "服务连接失败或超时")
MODEL_WORDS = ("llm/api", "研究员节点", "验证节点", "纠错节点", "模型中转", "大模型")

# Parts of a profile that speak of a high honour, in order.
BASIS_PATTERNS = (
    r"[^；。]{0,80}(?:美国国家科学院|National Academy|院士|Academician)[^；。]{0,80}",
    r"[^；。]{0,80}(?:CIGR|IEEE Fellow|ACM Fellow|AAAI Fellow|Royal Society)[^；。]{0,80}",
    r"[^；。]{0,80}(?:世界粮食奖|World Food Prize|诺贝尔|Nobel|图灵奖|Turing Award|菲尔兹|Fields Medal)[^；。]{0,80}",
    r"[^；。]{0,80}(?:全球前2%|斯坦福2%|高被引学者|Highly Cited Researcher)[^；。]{0,80}",
)
