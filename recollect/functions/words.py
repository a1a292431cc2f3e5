"""Word lists. Results depend on every entry."""

STOPWORDS = """
the a an and or of to in on for is are it this that with as at by be from you your we i how what why was were will can do does
my me our they them he she its but so if not no yes up out about into than then there here when where which who all any some just
very more most one two get got make made let
""".split()

FUNCTION_CHARS = (
    "的了是在和就都而及与也很到我你他她它们这那个可以什么怎样还有要会能说去来做"
    "得着过被把让给对从向为于不没无上下中里外前后之其此但因所然则又再才只更最太"
    "些种时候用好大小多少等吧呢吗啊呀哦嗯如果或者且并虽且比如及至由该们哪谁咱您"
)

GENRE_WORDS = """
原理 详解 讲解 精讲 精读 解析 教程 入门 实战 实测 笔记 分享 总结 干货 科普 揭秘 指南 手册 系列 合集
全集 完整 版本 最新 推荐 盘点 对比 测评 体验 记录 过程 全程 手把手 保姆级 从零 零基础 一文 看懂 学会
做法 方法 方式 情况 东西 地方 内容 问题 区别 意思
""".split()

#: Kana, ideographs (extension A, the main block, compatibility forms, extension B) and hangul syllables: first and last code points, in code-point order.
CJK_BLOCKS = ((0x3040, 0x30FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0x20000, 0x2A6DF))

#: A word of Latin letters and digits in normalised text.
WORD = r"[a-z0-9][a-z0-9'_+#.\-]*"
