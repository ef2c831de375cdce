"""Language packs: patterns and limits as data. Patterns are written so that Java and RE2 read them alike."""

from __future__ import annotations

HAN = "一-鿿"

#: Patterns of the Chinese pack, counted over a whole text.
COUNTS = {
    "simile": "像|如同|仿佛|宛如|好似|犹如|恰似",
    "excl": "[！!]",
    "dash": "——",
    "ellipsis": "……",
    "piled": f"(?:[{HAN}]{{1,4}}的){{3,}}[{HAN}]",
    "notbut": "不是[^。！？!?]{1,15}[，,]而是",
    "pacer": "瞬间|刹那|转瞬|须臾|顷刻|陡然|骤然|猛地|猛的|霍然|顿时|蓦地|倏",
    "connector": "然而|与此同时|此时此刻|不知为何|岂料|谁知|不由得",
    "pacer_phrase": "在[^。，！？]{0,10}的(?:瞬间|刹那|一瞬)",
    "emotion": "(?:内心|心中|心底|心里)(?:充满|涌起|泛起|升起|掀起|一片)|(?:复杂的|难以言喻的|说不出的|莫名的|异样的)(?:情绪|感觉|滋味|心境)|(?:情绪|心情)(?:复杂|沉重)|(?:充满|满是|写满)了?(?:坚定|决绝|震惊|担忧|期待|感激|疑惑)",
    "theme": "(?:这一刻|那一刻|那一瞬间|从这一刻起)[^。！？]{0,25}(?:明白|懂得|知道|领悟|意识到)|(?:命运的齿轮|命运的安排|注定了)|(?:就是|才是)(?:成长|人生|命运|道)(?:的意义|的真谛)?",
    "explain": "[”」][^。！？]{0,40}?(?:眼|眸|神情|神色|语气|目光|眉宇)(?:中|里|间)?(?:透露出|充满|写满|带着|闪过|流露出|浮现)",
    "interrupt": "打断|没说完|说到一半|话没说完|抢过话|截住他的话",
    "silence": "(?:没|没有|不)(?:有)?(?:说话|出声|回答|接话|吭声)|沉默|哑然|张了张嘴|欲言又止|别过脸",
    "setback": "代价|损失|失败|错了|误判|来不及|后悔|吃亏|赔|受挫|低估",
    "punct_repeat": "！！+|？？+|。。+|，，+|、、+|；；+|!!+|\\?\\?+",
    "halfwidth": f"[{HAN}][,.!?;:][{HAN}]",
    "sight": "看|瞧|盯|瞥|瞄|目光|视线|眼神|颜色|光亮|发亮|昏暗|阴影",
    "hearing": "听|声响|声音|响声|喊|嚷|吼|嗡|轰|哗啦|叮当|咕嘟|安静|沉默|嗓",
    "smell": "闻|气味|香味|香气|腥|烟味|糊味|臭",
    "taste": "尝|甜|苦|咸|酸|涩|辣|味道|舌尖",
    "touch": "冷|热|烫|凉|冰|疼|痛|麻|痒|湿|潮|硬|粗糙|黏|硌|寒|暖|闷",
}
#: Patterns counted over narration, without quoted speech and headings.
NARRATION_COUNTS = {
    "buzz": "赔付|机制|优化|绩效|指标|闭环|赋能|抓手|系统性|结构性|标准化|规范化|底层逻辑|颗粒度|流程化|体系化|维度|层逻辑|整体而言|综合来看",
    "sci": "毛细血管|末梢|神经|细胞|分子|原子|离子|血液|红细胞|白细胞|蛋白|酶|激素|热力学|动能|势能|湍流|压强|密度|频率|振幅|电磁|光谱|辐射|粒子|对撞|真空|切伦科夫|氧化|还原|催化|燃烧值|参量|矢量|标量|腔体|介质|导体|绝缘|半衰期|下丘脑|视网膜|耳膜?内?侧|脑颅|肌肉纤维|生物碱|拟交感",
    "mechanism": "(?:那是|那是由于|也就是|实际上是|本质上(?:是)?|原因在于|原理是)[^。]{0,40}?(?:毛细血管|末梢|神经|细胞|分子|血液|红细胞|蛋白|热力学|氧化|湍流|压强|频率|电磁|辐射|离子|膜电位|生物碱)",
    "action": "砍|劈|刺|格|挡|闪|避|跃|扑|冲|撞|踢|拳|掌|剑|刀|枪|弓|弩|盾|甲|跌|摔|滚|爬|退|转|跳|抓|掀|砸|崩|裂|血|伤|痛|喘|汗|溅|倒|扑通|哗啦",
    "tension": "追|逃|窜|躲|奔|跑|抢|翻|跨|截|拦|围|逼|甩|扯|拽|踹|惊|骇|恐|惧|慌|颤|抖|嘶|吼|喊|叫|哭|僵|缩|屏|呛|砰|轰|哗|啪|嗵|咚|塌",
}
#: Further patterns.
FEEL = "疼|痛|冷|热|烫|累|酸|麻|慌|怒|急|闷|堵|怕|沉|空|软|倦|渴|饿|哽|涩"
JUDGE = "明白|懂了|知道|意识到|想通|看清|认出|察觉|猜到|发现|确定|清楚|醒悟"
SUM_UP = "终于|从此|再也|注定|一切|所有|全都|永远|结束|回不去|原来|这就是|没有了|完了|晚了"
DASH_END = "[“「]([^”」]{3,400})——[”」]"
ELLIPSIS_END = "[“「]([^”」]{3,400})……[”」]"
NOISE = "^[沙嗡咚轰哗啦丁当吱咔扑通骨碌]+(?:[—…][沙嗡咚轰哗啦丁当吱咔扑通骨碌]+)*[—…]?$"
SPEECH = "[“「『][^”」』]*[”」』]"
QUOTE = "[“「]([^”」]{1,400})[”」]"
SENTENCE_END = "[。！？!?…]+|(?:\\r?\\n)+"
OPEN_TIME = "^(?:清晨|早晨|一大早|天刚|天还没|天亮|夜里|夜色|入夜|傍晚|黄昏|日头|晌午|午后|正午|深夜|半夜|次日|翌日|第二天|三日|数日|月光|晨光|天光|天色|风起|风声|大雨|雨|雪|雾)"
EXPO_TERM = "细胞|分子|离子|黏膜|神经|物理|化学|杂质|氯化|结晶|挥发|酸气|受体|含量|浓度|提纯|纯度|血红|蛋白|免疫|热力学|压强|密度|频率|氧化|还原|催化|官盐|粗盐|精盐|雪盐|溶解|过滤|重结晶|刑统|县衙|生员|御史|朝廷|礼房|勾牒|军械|律例|律法|品级|俸禄"
EXPO_CONNECTOR = "因为|所以|这是|那是|原来|正因|毕竟|只要|意味着|能够|属于|称为|不过是|正是因为|也就是说|换句话说|本质上|由此|可见|凡是|一律|按律|依律"
EXPO_ACTION = "走|跑|站|坐|躺|趴|蹲|跪|拿|放|推|拉|抱|按|抓|掀|砸|扔|塞|浇|烧|煮|挖|搬|端|递|接|穿|脱|洗|擦|敲|踩|跨|扶|挥|甩|踢|砍|劈|刺|挡|闪|避|跃|扑|冲|撞|抖|缩|退|转|抬|低|伸|握|咳|笑|哭|喊|吼|叫|瞪|盯|瞧|瞥|摸|碰|停|跺|迈|挪|靠|倚|拽|扯|拖|咬|吐|吞|咽"
LITERARY = "之|其|方|乃|岂|焉|哉|矣|乎|吾|汝|尔|阁下|老夫|在下|晚生"
COLLOQUIAL = "老子|俺|咱|呗|咋|啥|喽|嘛|哎哟|娘的|他娘的|得嘞"
CARE = "送饭|送来饭菜|递茶|递水|端来|端上|熬了?粥|熬了?汤|煎了?药|掖被|盖好?被|掖好|披衣|添衣|添了?炭"
APHORISM = "命运|人生|人心|世界从来|这个世界|时代|历史总是|永远|从来|终究|不过是|总有一天|总有一日|这就是|从此再无|再也回不去|谁也逃不过"
GESTURE = "手|指|肩|眼|眸|眉|唇|攥|捏|摩挲|捻|搓|抚|敲|叩|绞|把玩|把弄|转着|掂"
CHAPTER_HEAD = "^[ \\t]*(?:#{1,6}[ \\t]*)?第[0-9零一二三四五六七八九十百千两]+[章节][^\\n]{0,40}$"
#: Per mille limits, then limits per text.
DENSITY_LIMITS = {"simile": 2.5, "excl": 6.0, "pacer": 2.5, "connector": 1.0, "dash": 3.0, "ellipsis": 3.0}
COUNT_LIMITS = {"piled": 2, "notbut": 2, "pacer_phrase": 2, "emotion": 2, "theme": 1, "explain": 2}
NARRATION_LIMITS = {"buzz": 1.0, "sci": 2.5}
SHORT, LONG, COMMAS, STD_LEAST, SHORT_LEAST = 12, 60, 7, 8.0, 0.15
CHAPTER_TYPES = ("推进", "高潮", "过渡", "关系", "线索", "代价")
#: Anchors of human prose, the range that others must lie in, and how many digits are kept.
ANCHORS = {"sentence_median": 38.9, "short20_ratio": 0.19, "ellipsis": 1.1}
ANCHOR_RANGES = {"sentence_median": (5, 120), "short20_ratio": (0, 1), "ellipsis": (0, 20)}
ANCHOR_DIGITS = {"sentence_median": 1, "short20_ratio": 3, "ellipsis": 2}
#: What each type of chapter needs and what it should avoid, in our own words.
GUIDE = {
    "推进": ("a plot point that changes the situation", "explanation without movement"),
    "高潮": ("conflict of four or more and a consequence that lasts", "victory without a price"),
    "过渡": ("a change of relation, world or mood", "the payoff of a main thread"),
    "关系": ("a relation that changes in action or speech", "change that is only told"),
    "线索": ("a thread or a term, and a new question", "every question answered at once"),
    "代价": ("a loss that is named and felt later", "a loss made good at once"),
}
STALE = {1: 35, 2: 12, 3: 4}
SCOPE = {1: "book", 2: "arc", 3: "chapter"}
#: The default ban list, plain phrases and then patterns.
BANNED = ("一丝", "一抹", "不禁", "眸中", "眼底闪过", "眼中闪过", "嘴角勾起", "空气仿佛凝固", "深吸一口气")
BANNED_PATTERNS = ("不是[^。!?]{1,12}[,，]而是", "总之[,,，。!]", "(毕竟|总的来说)[,,，。]")
HALFWIDTH = {",": "，", ".": "。", "!": "！", "?": "？", ";": "；", ":": "："}
#: Our own rules: (id, level, mode, kind, pattern, hint), in the order of a rule library.
RULES = tuple(
    [(f"R{i + 1:03d}", "core", "ban", "word", p, "说得再具体些") for i, p in enumerate(BANNED)]
    + [(f"R{i + 101:03d}", "standard", "ban", "regex", p, "拆开来写") for i, p in enumerate(BANNED_PATTERNS)]
    + [(f"R{i + 201:03d}", "wide", "watch", "word", p, "看密度") for i, p in enumerate(("没有人应声", "压低了嗓子", "退了半步", "把话咽了回去", "忽然改了主意", "没有回头"))]
    + [(f"R{i + 301:03d}", "wide", "watch", "regex", p, "看密度") for i, p in enumerate(("(?:道|说)：“", "[！？]”", "\\bthe \\w+ed\\b", "(?:看了|盯着).{0,6}很久"))]
)
#: Our own larger library: category -> (level, mode, hint, words). A word that starts with `regex:` is a pattern.
CATEGORIES = {
    "gaze": ("core", "ban", "说清看见了什么", "目光如炬 眼神复杂 眼神一凛 眸光微动 意味深长地看 目光深邃 眼底划过一丝"),
    "mouth": ("core", "ban", "换成动作或对话", "嘴角微微上扬 唇角一勾 扯出一抹笑 抿了抿唇 嘴角抽了抽 勾起一抹弧度"),
    "breath": ("core", "ban", "写身体的具体反应", "倒吸一口凉气 屏住呼吸 呼吸一滞 长舒一口气 吐出一口浊气 呼吸急促起来"),
    "air": ("core", "ban", "写在场的人做了什么", "空气骤然凝固 气氛顿时凝重 周围一片死寂 时间仿佛静止 一股寒意袭来 空气中弥漫着"),
    "heart": ("standard", "ban", "写念头的内容", "心中一凛 心头一震 心中涌起 心里咯噔一下 心如刀绞 百感交集 五味杂陈"),
    "body": ("standard", "ban", "一处细节就够", "身形一滞 身躯一震 浑身一颤 瞳孔骤缩 指节泛白 后背一凉 双腿发软"),
    "voice": ("standard", "ban", "让话自己说", "声音低沉 语气淡淡 一字一顿 声音沙哑 冷声道 沉声道 不容置疑的语气"),
    "time": ("standard", "ban", "写出隔了多久", "不知过了多久 转眼之间 电光火石之间 一时之间 刹那之间 说时迟那时快"),
    "turn": ("standard", "ban", "直接写变化", "就在这时 殊不知 话音刚落 然而下一秒 没想到的是 令人意外的是"),
    "summary": ("standard", "ban", "留给读者", "总而言之 由此可见 不难看出 归根结底 综上所述 毫无疑问 regex:这(?:不仅|不只)是[^。]{1,20}更是"),
    "simile": ("standard", "watch", "一段一个比喻", "如同一把利刃 仿佛一座大山 宛如雕塑 像一头野兽 犹如晴天霹雳 好似一尊石像"),
    "degree": ("standard", "watch", "删去试试", "无比 极其 异常地 格外地 前所未有 难以置信 无法形容"),
    "smile": ("wide", "watch", "一章几次", "微微一笑 淡然一笑 苦笑一声 轻笑出声 哑然失笑 冷笑一声"),
    "nod": ("wide", "watch", "一章几次", "点了点头 摇了摇头 叹了口气 皱了皱眉 挑了挑眉 耸了耸肩"),
    "hands": ("wide", "watch", "一章几次", "握紧拳头 攥紧了手 摆了摆手 拍了拍肩 揉了揉眉心 搓了搓手"),
    "silence": ("wide", "watch", "写沉默里的事", "陷入沉默 沉默了片刻 半晌无言 良久没有说话 谁也没有开口 一阵沉默"),
    "weather": ("wide", "watch", "与情节有关才写", "夜色如墨 月光如水 寒风凛冽 细雨绵绵 天色渐暗 残阳如血"),
    "frames": ("wide", "watch", "换一种开头或结尾", "regex:^(?:清晨|黄昏|深夜)， 故事才刚刚开始 一切才刚刚开始 新的一天开始了 命运的齿轮 好戏还在后头"),
    "english": ("wide", "watch", "say it plainly", "regex:\\ba\\x20testament\\x20to\\b regex:\\bcould\\x20not\\x20help\\x20but\\b regex:\\bsent\\x20shivers\\b regex:\\bsteely\\x20gaze\\b"),
}
LEVELS = {"core": 1, "standard": 2, "wide": 3}
_MORE = [(c, level, mode, hint, w) for c, (level, mode, hint, words) in CATEGORIES.items() for w in words.split()]
#: The default rules and the larger library together; the id of a rule of the library names its category.
LIBRARY = RULES + tuple((f"{c}-{i + 1:03d}", level, mode, "regex" if w.startswith("regex:") else "word", w.removeprefix("regex:"), hint) for i, (c, level, mode, hint, w) in enumerate(_MORE))
