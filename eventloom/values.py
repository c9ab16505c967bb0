"""Fixed values that results depend on: platform kinds, credibility tiers, word lists, labels."""

# Kinds of text by platform.
PLATFORM_TEXT_TYPES = {
    "微博": "comment",
    "论坛": "comment",
    "知乎": "comment",
    "新闻客户端": "article",
    "官方网站": "article",
    "官网": "article",
    "新浪新闻": "article",
    "澎湃新闻": "article",
}
# Credibility tiers and their weights.
TIER_WEIGHTS = {"官方平台": 1.0, "官方机构": 1.0, "认证机构": 0.75, "头部认证个人": 0.5, "认证个人": 0.3, "普通用户": 0.1}
PLAIN = "普通用户"
OFFICIAL = ["官方平台", "官方机构"]
BIG_V = ["头部认证个人", "认证机构"]
# News platforms whose documents without a tier count as official.
NEWS_PLATFORMS = ["新浪新闻", "澎湃新闻", "新华社", "人民日报", "光明网", "人民网"]
# Outlets whose social accounts are official.
OFFICIAL_ACCOUNTS = ["人民日报", "央视新闻", "新华社", "人民网", "光明网"]
# Roles of key nodes, by priority.
ROLES = ["初始爆料", "首次大V发声", "首次官方媒体介入", "传播高峰"]
# Words in roles by which nodes are shown as a beginning, a peak, an opinion leader or an official voice.
ROLE_BEGINS, ROLE_PEAKS, ROLE_LEADS, ROLE_SPEAKS = "初始|首发|爆料", "高峰|峰值", "大V|意见领袖", "官方|媒体|通报"
TIERS_LEAD, TIERS_SPEAK = "头部认证个人|认证机构", "官方平台|官方机构"
# Badges and headlines of accounts on a question-and-answer site.
TOP_BADGES = ["best_answerer", "high_salt", "sea_salt_creator"]
OFFICIAL_HEADLINE = "官方|客服|小编"
# Display labels.
RISK_LABELS = {"high": "高", "mid_high": "中高", "medium_high": "中高", "mid": "中", "medium": "中", "low": "低"}
STAGE_LABELS = {"latent": "潜伏期", "growth": "成长期", "peak": "高潮期", "decline": "衰退期"}
STAGES = ["latent", "growth", "peak", "decline"]
# Groups of keywords on the event page; the last takes the rest.
KEYWORD_GROUPS = {
    "救援行动": ["救援", "物资", "转移", "求助", "补偿", "改签"],
    "灾害影响": ["暴雨", "积水", "路况", "延误", "高温", "停水"],
    "官方响应": ["应急", "通报", "气象预警", "公告", "说明", "规则"],
}
KEYWORD_REST = "公众反馈"
# Sentiment words.
POSITIVE = ["支持", "点赞", "赞扬", "满意", "喜欢", "感谢", "欣慰", "振奋", "希望", "成功", "进步", "改善", "顺利", "认可", "肯定", "暖心", "好评"]
NEGATIVE = ["愤怒", "谴责", "批评", "担忧", "失望", "不满", "抗议", "质疑", "恐慌", "悲痛", "谣言", "违规", "事故", "损失", "危机", "崩溃", "差评"]
# Endings that make a word a place, words that are no people, and outlets that sign as authors.
PLACE_SUFFIXES = ["省", "市", "区", "县", "镇", "乡", "村", "州", "路", "街道", "水库"]
NO_PEOPLE = ["雷雨", "雷阵雨", "厄尔尼诺", "拉尼娜", "高中生", "大学生", "小学生", "谢谢你们"]
OUTLETS = ["央视新闻", "新华社", "人民日报", "澎湃新闻", "环球时报", "中国新闻网", "光明网", "人民网", "新浪新闻", "参考消息", "观察者网"]
# Sentences that platforms append to articles.
BOILERPLATE = {
    "新浪新闻": [
        "特别声明：以上文章内容仅代表作者本人观点，不代表新浪网观点或立场。如有关于作品内容、版权或其它问题请于作品发表后的30日内与新浪网联系。",
        "特别声明：以上文章内容仅代表作者本人观点，不代表新浪网观点或立场。如关于作品内容、版权或其它问题请于作品发表后的30日内与新浪网联系。",
        "声明：本文内容仅代表作者个人观点，与新浪网无关。",
    ]
}
# Aliases of training labels.
LABEL_ALIASES = {"0": "negative", "1": "positive", "neg": "negative", "pos": "positive", "negative": "negative", "positive": "positive", "neutral": "neutral"}
