"""Marks of exam texts.  Fixed values: the patterns and word lists that exam lines are told apart by.

They are written so that Java, Python and RE2 read them alike.  Texts are expected after NFKC.
"""

NUMBER = "[0-9]{1,3}|[一二三四五六七八九十百]{1,6}"
QUESTION = rf"^\s*(?:#+\s*)?(?:第\s*)?(?:{NUMBER})\s*(?:题|[.、．)])\s*"
SECTION_NAMES = "单项选择题|多项选择题|不定项选择题|判断题|填空题|简答题|计算题|案例分析题|综合题|材料分析题"
SECTION = rf"^\s*(?:#+\s*)?(?:第\s*[一二三四五六七八九十百0-9]+\s*部分\s*)?(?:{SECTION_NAMES})\s*$"
#: The form of the line models: numbered headings, and words after the name.
SECTION_START = rf"^\s*(?:#+\s*)?(?:(?:第\s*[一二三四五六七八九十百0-9]+\s*部分)|(?:[一二三四五六七八九十百0-9]+\s*[、.．]))?\s*(?:{SECTION_NAMES})"
LABEL = r"[A-H][.、．)]"
OPTION = rf"^\s*{LABEL}\s*"
ENTRY = r"^\s*(?:借|贷)\s*[:：]"
ANSWER = r"(?:答案|参考答案|正确答案)\s*[:：]"
ANALYSIS = r"(?:解析|答案解析|【解析】)"
ANSWER_HEAD = rf"^\s*(?:#+\s*)?{ANSWER}"
ANALYSIS_HEAD = rf"^\s*(?:#+\s*)?{ANALYSIS}\s*(?:[:：]|\n)"
ANALYSIS_LINE = rf"^\s*(?:#+\s*)?{ANALYSIS}\s*(?:[:：]|\s*$)"
PAGE_NUMBER = r"^(?:第\s*)?[0-9]+\s*(?:页|頁|/+\s*[0-9]+)?$"
PAGE_OF = r"^(?:[Pp][Aa][Gg][Ee]\s*)?[0-9]+\s*/\s*[0-9]+$"
SHORT_NUMBER = r"^[0-9]{1,3}$"
SYMBOLS = r"^[\s\-_=~·•⋅…—–_（）(){}\[\]<>【】《》。、，,.:：;；|/\\]+$"
SIGN = "[一-鿿A-Za-z0-9]"
HAN = "[一-鿿]"
HINTS = ("二维码", "公众号", "微信", "扫一扫", "扫描", "内部资料", "仅供参考", "版权所有")
#: Marks that a line is cut back to where only noise stands before them, in the order they are tried.
PREFIXED = ("答案：", "答案:", "解析：", "解析:", "借：", "借:", "贷：", "贷:")
#: Lines of exams that repeat over pages and are no noise; digits have become #, white space is gone (the last two: it is not).
STRUCTURE = (r"第#小题", r"根据资料[#一二三四五六七八九十①②③④⑤⑥⑦⑧⑨⑩]", r"答案与解析|答案解析|正确答案|参考答案", r"不定项选择题")
STRUCTURE_LINE = (r"^[A-H][\\.、．)]", r"[A-H][\\.、．)].*[B-H][\\.、．)]")
#: Words of a stem that options may follow on the same line.
CUES = ("下列", "的是", "正确", "属于")
STOPS = ("。", "！", "？", "；", ";")
