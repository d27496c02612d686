"""Scores for abusive, hateful and sexually explicit text.

A cascade of finite-state machines: text is brought into a skeleton in which spellings of one word are equal, a lexicon
turns it into a row of word classes and gaps, and a weighted clause grammar, composed from machines for reported and
negated speech, insults, threats, groups and sexual demands, weighs whole clauses. Single words, other than curses and
slurs, weigh too little to count by themselves. The lexicon is of general language; the names of the groups that a
corpus hates are learned from labelled texts, by the places in which they stand.
"""

from collections.abc import Iterable
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import DoubleType, StructField, StructType

from hilite.llm.automata import Lexicon, Machine, Scorer, Sequential, composed, searching
from hilite.llm.canonical import SIZE, canonical_points, chunks, decode, kept, rows_of, tables, texts_of
from hilite.llm.runs import letters

LABELS = ("abuse", "hate", "sexual")
THRESHOLD = 0.5

# Symbols of the grammar: word classes, then gaps by their number of characters (FAR: over 12 characters or Latin words), then ends of clause and sentence.
CLASSES = (
    "INSULT", "NOUN", "WEAK", "VERY", "CURSE", "SLUR", "DIRECT", "IS", "ORDER", "DEATH", "WISH", "SUICIDE", "INTENT", "KILL", "THREAT", "LIKE", "GROUP", "DEHUMAN", "WORTHLESS", "LEAVE", "PURGE", "SEX", "RAPE", "WANT", "BODY", "LUST", "STRIP", "NUDE",
    "BEG", "NEG", "REPORT", "CITED", "BENIGN", "MENTION",
)
GAPS = ("G2", "G6", "G12", "FAR", "COMMA", "BREAK")
SYMBOL = {name: i for i, name in enumerate((*CLASSES, *GAPS))}


def products(*parts: str) -> str:
    """Every word made of one of each of parts."""
    out = [""]
    for p in parts:
        out = [a + b for a in out for b in p.split()]
    return " ".join(out)


# The words of each class, of general language; compounds that follow a rule are products of their parts.
# NOUN: words that insult as what someone is called, and are things or animals otherwise. Names of groups of a corpus
# are a parameter of the functions below.
WORDS = {
    "INSULT": "白痴 蠢货 蠢猪 畜生 废物 智障 脑残 脑瘫 弱智 低能儿 狗东西 傻逼 傻叉 傻缺 傻狗 混蛋 王八蛋 贱人 贱货 杂种 人渣 败类 狗屎 狗杂种 猪脑子 脑子进水 不要脸 臭不要脸 孬种 窝囊废 二百五 脑子有病 有病吧 "
    + products("恶心的 没脑子的 垃圾 不要脸的 没用的 下贱的 该死的", "东西 玩意")
    + " idiot moron dumbass bitch loser scumbag scum dimwit jackass asshole bastard retard imbecile cretin twat cunt whore slut halfwit numbskull braindead lowlife degenerate sonofabitch motherfucker piece_of_shit "
    + products("clown pea bird shit dick ass fuck bone block butt dung", "brain head face wit hole")
    + " クズ野郎 クソ野郎 ゴミ野郎 バカ野郎 馬鹿野郎 クソガキ",
    "NOUN": "trash garbage clown pig cow dog rat waste joke disgrace prick donkey 垃圾 猪 狗 ゴミ クズ",
    "WEAK": "恶心 蠢 stupid dumb pathetic worthless disgusting バカ アホ 馬鹿 傻瓜 没脑子 下贱",
    "VERY": "absolute absolutely total complete utter fucking bloody damn such pieceof apieceof bunchof loadof",
    "CURSE": "操你 操你妈 操你大爷 草泥马 日你妈 去你妈 去你妈的 滚你妈 你妈死了 死妈 nmsl cnm fuckyou fucku fuckoff screwyou eatshit suckmydick くたばれ",
    "SLUR": "nigger nigga chink gook spic kike wetback raghead faggot fag tranny shemale towelhead 黑鬼 支那 支那人 尼哥 死基佬 死同性恋 死变态 支那猪 チョン",
    "DIRECT": "你 你们 楼主 楼上 楼下 前面那个 前面的 后面那个 后面的 up主 作者 字幕组 你全家 你妈 这群 这帮 某些人 "
    + products("发 刷 剪 做 弄 搞 传 投", "弹幕 屏 辑 视频 字幕 稿", "的")
    + " 字幕组的 you your youre ur ya u yall whoever お前 おまえ てめえ 貴様",
    "IS": "are r is isa isan be were arejust areall areall_just islike arelike 是 就是 就是个 都是 全是 真是 是个 像 就像 像个 算是 这种 这 那种 这个",
    "ORDER": "滚 滚开 滚出去 给我滚 给我爬 爬远点 闭嘴 stfu shutup shutthefuckup getlost gotohell " + products("nobody noone", "asked cares") + " 黙れ 失せろ 消えろ",
    "DEATH": "去死 去死吧 死全家 godie 死ね",
    "WISH": products("怎么还不 怎么不 早点 赶紧 快点 快去", "去死 死") + " " + products("quit stop cease", "breathing living existing") + " dieinafire dropdead hopeyoudie",
    "SUICIDE": "kys killurself " + products("kill hang shoot drown", "yourself yourselves") + " 去自杀 自杀吧 自杀去吧 自殺しろ",
    "INTENT": "iwill ill igonna imgonna iamgonna imgoingto iamgoingto iwant_to iwanna imabout_to ima wewill wegonna weregonna weregoingto wearegoingto letme 我要 我会 我想 我一定 老子要 老子",
    "KILL": "kill murder stab shoot strangle behead slaughter beat hurt",
    "THREAT": products("弄 打 砍 杀 捅 整 揍 掐 勒 炸 烧", "死你 死你们 死你全家") + " 杀了你 宰了你 砍了你 废了你 杀你全家 打断你的腿 killyourfamily slityourthroat breakyourneck breakyourlegs huntyoudown beatyouto_death ぶっ殺す ぶっ殺し ぶち殺す ぶち殺し ブッ殺す 殺してやる 殺すぞ お前を殺す",
    "LIKE": "likeyou likeu likethem",
    "GROUP": "佬 族 教徒 裔 蛮子 黑人 白人 犹太人 穆斯林 移民 难民 外国人 外地人 乡下人 农村人 女人 男人 同性恋 基佬 immigrant refugee foreigner migrant muslim jew jews black mexican asian arab african gay gays lesbian trans women christian gypsy gypsies homosexual",
    "DEHUMAN": products("全 都 统统 全部", "赶出去 赶走 该死 滚回去 滚出去") + " 滚回去 滚回老家 该死 就想吐 低等 劣等 下等 死光 areanimals areadisease areaplague arefilth arescum arerats shoulddie should_die should_all_die shouldallbe_killed deservetodie",
    "WORTHLESS": products("不配 不配来", "当人 做人 活着 活") + " 没一个好东西 没有一个好东西 没一个好人 没有一个好人 猪狗不如 deservetolive deserves_to_live deservetoexist subhuman vermin cockroaches",
    "LEAVE": "should_leave must_leave shouldgoback goback get_out shouldbedeported should_be_banned 滚出中国 滚出去",
    "PURGE": products("wipeout exterminate getridof deport gas lynch eradicate kill killoff burn hang", "every all allthe allthose") + " 杀光 灭了所有 消灭所有 灭绝 全杀了 都杀了",
    "SEX": "约炮 打炮 一夜情 fuckable sendnudes sendmenudes showmeyourtits takeitalloff suckmy suckmycock 裸照发我 发裸照 脱给我看 喷精 射精 肉棒 骚逼 ヤりたい fuckyousobad fuckyoutonight",
    "RAPE": products("rape molest grope", "her him you them me") + " 强奸你 强奸她 轮奸她 轮奸你 强奸了 犯してやる",
    "WANT": "好想上了 想上了 今晚就睡 想睡了 want_to_bang wannabang want_to_fuck wannafuck want_to_smash 想操 想日",
    "BODY": "胸 胸部 奶子 屁股 大腿 全身 下面 boobs tits butt ass",
    "LUST": "想揉 好想揉 想舔 想摸 好想摸 想捏 想吸 want_to_lick want_to_grope",
    "STRIP": "脱光 扒光 脱衣 剥光",
    "NUDE": "裸照 裸体 无码 无修正 nudes nude naked",
    "BEG": "求 想看 发我 给我 有没有 想把 把 send show",
    "NEG": "别 不要 请勿 禁止 拒绝 不说 不许 别再 别骂 不是 并不是 又不是 并非 不算 不像 不觉得 不认为 没骂 没说 没叫 从不 绝不 dont donot never not stop stopcalling no arent isnt aint",
    "REPORT": "骂自己 自称 骂 骂人 自嘲 说自己 说我 叫我 被叫 被骂 callpeople calling called call calls said says 引用",
    "CITED": "那句 这句 那段 这段台词 的台词 这个词",
    "BENIGN": "是不是 不是吗 垃圾分类 垃圾山 垃圾桶 垃圾车 垃圾场 垃圾袋 垃圾箱 废物利用 死亡谷 去死亡 死亡 死而无憾 摇滚 滚动 翻滚 打滚 滚筒 特别 区别 分别 告别 级别 性别 类别 离别 别人 别的 个别 别墅 "
    "热狗 猪肉 猪排 小猪 小狗 trashpanda trashcan trash_day trash_bag thetrash thegarbage garbage_day shutupandtakemymoney killingit killit hotdog 胸口 胸怀 胸针 胸有成竹 裸眼 摸鱼 想摸鱼 摸头 要不要 不蠢 不恶心 不垃圾 "
    "求展开 求问 求助 求资源 求后续 把握 一把 请求 要求 追求 需求 笑死 哭死 甜死 美死 萌死 该死的甜美 爬山 死去活来 贵族 家族 民族 水族 上班族 坏人 蚊子 蟑螂 老鼠 rats mice boss bosses zombies monsters enemies bugs",
}
# Other spellings of a part of a word that are no words themselves.
ALIASES = {"垃圾": "辣鸡 拉圾 垃鸡", "裸照": "果照 luo照", "傻逼": "煞笔 傻比 沙比", "智障": "制杖 智帐", "脑残": "脑惨 恼残", "白痴": "白癡", "畜生": "畜牲 蓄生", "废物": "费物", "蠢货": "春货",
           "约炮": "约泡", "狗东西": "苟东西 狗东東西", "去死": "去屎", "无码": "無码", "东西": "東西", "滚": "衮", "脱光": "脫光"}
# How characters of these words are read.
READINGS = dict(zip(
    "白痴蠢货猪畜生废物智障脑残瘫弱低能垃圾玩意东西狗恶心没子的傻逼叉混蛋王八贱人杂种渣败类屎死去滚爬闭嘴赶出回该配当做好个一想吐等劣约炮打裸照脱光扒剥无码修正胸揉舔摸捏吸睡上求全身屁股腿奶杀灭绝怎么还不早点就",
    "bai chi chun huo zhu chu sheng fei wu zhi zhang nao can tan ruo di neng la ji wan yi dong xi gou e xin mei zi de sha bi cha hun dan wang ba jian ren za zhong zha bai lei shi si qu gun pa bi zui gan chu hui gai pei dang zuo hao ge yi xiang tu deng lie yue pao da luo zhao tuo guang ba bo wu ma xiu zheng xiong rou tian mo nie xi shui shang qiu quan shen pi gu tui nai sha mie jue zen me hai bu zao dian jiu".split(),
    strict=True,
))
# Digits and signs and the letters written with them.
LEET = dict(zip("0134567@$|l+€£", "oieasgtasiiteg", strict=True)) | {"8": "b", "9": "g"}
WILD = "*"
COMMAS, ENDS = "，,、:：~", "。！？!?\n;；…"


def skeleton(word: str) -> str:
    """A word of the lexicon as it appears in a skeleton; parts between ``_`` are words in the text."""
    if "_" in word:
        return "".join(map(skeleton, word.split("_")))
    out = ""
    for c in word:
        c = LEET.get(c, c)
        if not out or out[-1] != c:
            out += c
    return out


def spellings(word: str) -> Iterable[str]:
    """word, with one character or all of them as they are read, with aliases, and Latin words with an inner vowel masked or left out."""
    yield word
    if "_" in word:
        yield word.replace("_", "")
    for part, others in ALIASES.items():
        if part in word:
            yield from (word.replace(part, x) for x in others.split())
    if word.isascii():
        for i in range(1, len(word) - 1):
            if word[i] in "aeiou" and len(word) > 3:
                yield word[:i] + WILD + word[i + 1 :]
                if len(word) > 4:
                    yield word[:i] + word[i + 1 :]
        return
    if len(word) > 1:
        for i, c in enumerate(word):
            if c in READINGS:
                yield word[:i] + READINGS[c] + word[i + 1 :]
                yield word[:i] + READINGS[c][0] + word[i + 1 :]
        if all(c in READINGS for c in word):
            yield "".join(READINGS[c] for c in word)


SPELLED_OUT = {"INSULT", "CURSE", "SLUR", "ORDER", "DEATH", "WISH", "SUICIDE", "KILL", "THREAT", "DEHUMAN", "WORTHLESS", "PURGE", "SEX", "RAPE", "WANT", "LUST", "STRIP", "NUDE", "GROUP"}
#: Classes whose own words win over other spellings of words of another class.
PLAIN = ("NOUN", "WEAK", "IS", "KILL", "BENIGN", "NEG", "REPORT", "DIRECT")


@cache
def lexicon(groups: tuple[str, ...] = ()) -> Lexicon:
    """The words of all classes in their spellings; groups: further names of groups."""
    words: dict[str, int] = {}
    own = WORDS | {"GROUP": f"{WORDS['GROUP']} {' '.join(groups)}"}
    for name in sorted(own, key=lambda n: n in SPELLED_OUT):  # these win where spellings of two classes are equal
        for word in own[name].split():
            short = name == "GROUP" and len(word) < 4 and not word.isascii()  # too short for spellings
            forms = spellings(word) if name in SPELLED_OUT and not short else [word]
            if word.isascii() and name in ("INSULT", "NOUN", "GROUP", "SLUR"):
                forms = [*forms, word + "s", word + "es"]
            for form in forms:
                words[skeleton(form)] = SYMBOL[name]
    for name in PLAIN:  # "kill" is also "killall" without its vowel
        words |= {skeleton(w): SYMBOL[name] for w in own[name].split()}
    return Lexicon(words)


def speech() -> Sequential:
    """What is negated or reported in the same clause becomes a mention: state 0 is plain, 1 and 2 follow a negation, 3 and 4 a report, 2 and 4 after a gap."""
    n = len(SYMBOL)
    to, out = np.zeros((5, n), np.int64), np.tile(np.arange(n), (5, 1))
    for state in (1, 2, 3, 4):
        to[state] = state
        to[state, SYMBOL["G6"]] = state + 1 if state in (1, 3) else 0
        to[state, [SYMBOL[x] for x in ("G12", "FAR", "COMMA", "BREAK")]] = 0
        for x in ("INSULT", "NOUN", "WEAK", "VERY", "CURSE", "DEATH", "SUICIDE", "KILL", "THREAT", "SEX", "WANT", "RAPE", *(("SLUR", "DEHUMAN", "WORTHLESS", "PURGE") if state > 2 else ())):
            out[state, SYMBOL[x]] = SYMBOL["MENTION"]
    to[:, SYMBOL["NEG"]] = 1
    to[:, SYMBOL["REPORT"]] = 3
    return Sequential(to, out)


def clauses() -> Scorer:
    """The clauses that count, with their weights."""
    s = SYMBOL
    near, wide = {s["G2"], s["G6"]}, {s["G2"], s["G6"], s["G12"]}
    words = {s[x] for x in ("DIRECT", "IS", "VERY", "WEAK", "NOUN", "BODY", "BEG", "GROUP", "CITED", "BENIGN", "LIKE", "ORDER", "INTENT", "KILL")}
    some = ("star", {*wide, *words})
    soft = ("star", {*near, s["COMMA"], s["DIRECT"], s["IS"], s["VERY"], s["WEAK"], s["BEG"], s["INTENT"], s["KILL"]})
    little = ("star", {*near, s["DIRECT"], s["IS"], s["VERY"], s["BODY"], s["INTENT"], s["KILL"], s["BEG"]})
    close = ("star", {s["G2"], s["IS"], s["VERY"], s["WEAK"]})
    m = Machine()
    abuse, hate, sexual = range(3)
    m.add([s["INSULT"]], {abuse: 0.4})
    m.add([s["ORDER"]], {abuse: 0.3})
    m.add([s["CURSE"]], {abuse: 0.9})
    m.add([s["DIRECT"], some, s["INSULT"]], {abuse: 1.0})
    m.add([s["DIRECT"], ("opt", wide), s["IS"], close, s["NOUN"]], {abuse: 0.8})
    m.add([s["DIRECT"], ("opt", {s["G2"]}), {s["WEAK"], s["VERY"], s["DIRECT"]}, ("opt", {s["G2"]}), s["NOUN"]], {abuse: 0.8})
    m.add([s["LIKE"], s["IS"], close, {s["NOUN"], s["INSULT"]}], {abuse: 0.9})
    m.add([s["DIRECT"], some, {s["WEAK"], s["NOUN"]}, ("star", near), s["ORDER"]], {abuse: 0.8})
    m.add([s["ORDER"], soft, {s["INSULT"], s["WEAK"], s["NOUN"]}], {abuse: 1.0})
    m.add([{s["INSULT"], s["NOUN"]}, soft, s["ORDER"]], {abuse: 1.0})
    m.add([s["INSULT"], ("opt", {s["COMMA"], s["G2"]}), s["INSULT"]], {abuse: 0.9})
    m.add([{s["INSULT"], s["WEAK"], s["NOUN"]}, s["LIKE"]], {abuse: 1.0})
    m.add([s["DIRECT"], little, s["DEATH"]], {abuse: 1.0})
    m.add([s["DEATH"]], {abuse: 0.45})
    m.add([s["DEATH"], soft, {s["INSULT"], s["NOUN"]}], {abuse: 1.0})
    m.add([s["WISH"]], {abuse: 0.6})
    m.add([s["SUICIDE"]], {abuse: 0.9})
    m.add([s["THREAT"]], {abuse: 0.9})
    m.add([s["INTENT"], ("star", near), s["KILL"], ("opt", {s["G2"]}), s["DIRECT"]], {abuse: 0.9})
    m.add([s["SLUR"]], {hate: 0.9})
    m.add([s["GROUP"], some, {s["DEHUMAN"], s["DEATH"], s["WISH"], s["INSULT"], s["SUICIDE"]}], {hate: 1.0})
    m.add([s["GROUP"], little, {s["IS"]}, ("star", near), s["NOUN"]], {hate: 0.8})
    m.add([s["GROUP"], little, s["LEAVE"]], {hate: 0.9})
    m.add([{s["PURGE"], s["KILL"]}, little, s["GROUP"]], {hate: 1.0})
    m.add([s["GROUP"], little, {s["PURGE"], s["KILL"]}], {hate: 1.0})
    m.add([s["WORTHLESS"]], {hate: 0.9})
    m.add([s["PURGE"]], {hate: 0.4})
    m.add([s["DEHUMAN"]], {hate: 0.4})
    m.add([s["SEX"]], {sexual: 1.0})
    m.add([s["RAPE"]], {sexual: 1.0})
    m.add([s["WANT"]], {sexual: 0.9})
    m.add([s["BODY"], some, s["LUST"]], {sexual: 1.0})
    m.add([s["LUST"], some, s["BODY"]], {sexual: 1.0})
    m.add([s["BEG"], some, {s["NUDE"], s["STRIP"]}], {sexual: 1.0})
    m.add([s["NUDE"], little, s["BEG"]], {sexual: 1.0})
    m.add([{s["NUDE"], s["STRIP"]}], {sexual: 0.4})
    return searching(m, len(SYMBOL), len(LABELS))


@cache
def grammar() -> Scorer:
    return composed(speech(), clauses())


@cache
def kinds() -> tuple[np.ndarray, np.ndarray]:
    """Every code point's skeleton, and its kind: 0 other, 1 Latin, 2 another letter, 3 comma, 4 end of sentence."""
    lower, letter = letters()
    folded = lower.copy()
    kind = np.where(letter, 2, 0).astype(np.uint8)
    for c, to in LEET.items():
        folded[ord(c)] = ord(to)
        kind[ord(c)] = 1
    for c in range(0x250):
        if letter[c]:
            kind[c] = 1
            low = int(folded[c])
            folded[c] = ord(LEET.get(chr(low), chr(low)))
    for i, signs in ((3, COMMAS), (4, ENDS)):
        for c in signs:
            kind[ord(c)] = i
    return folded, kind


def skeletons(cp: np.ndarray, starts: np.ndarray):
    """(code points, starts, begins: a Latin word or none begins here, stop: 3 or 4 where a clause or sentence ended before, alone: a Latin letter between signs) of canonical texts.

    Signs between the letters of a word go: a letter alone between signs belongs to the word of such letters before it.
    """
    folded, kind = kinds()
    row = rows_of(starts)
    k = kind[cp]
    n = len(cp)

    def shifted(x: np.ndarray, by: int, fill) -> np.ndarray:
        out = np.full(n, fill, x.dtype)
        if by > 0:
            out[by:] = x[:-by]
        else:
            out[:by] = x[-by:]
        return out

    star = cp == ord(WILD)
    latin = k == 1
    masked = star & shifted(latin, 1, False) & shifted(latin, -1, False) & ~shifted(star, 2, False) & ~shifted(star, -2, False)
    k = np.where(masked, 1, k)
    keep = (k == 1) | (k == 2)
    stops = np.where(keep, 0, k)
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(len(starts), np.int64), np.zeros(0, bool), np.zeros(0, np.uint8), np.zeros(0, bool)
    # the strongest sign between a kept character and the one before it
    from_ = np.append(0, at[:-1] + 1)
    padded = np.append(stops, 0)
    bounds = np.empty(2 * len(at), np.int64)
    bounds[0::2], bounds[1::2] = from_, at
    stop = np.maximum.reduceat(padded, bounds)[0::2]
    gap = at - from_ > 0
    stop = np.where(gap, stop, 0)
    new_row = np.append(True, row[at][1:] != row[at][:-1])
    gap |= new_row
    stop = np.where(new_row, 0, stop)
    after = np.append(gap[1:], True)
    alone = gap & after & (k[at] == 1)
    begins = gap & ~(alone & np.append(False, alone[:-1]) & ~new_row)
    lk = k[at]
    begins |= (lk == 1) & (np.append(0, lk[:-1]) != 1)
    out = np.where(masked[at], ord(WILD), folded[cp[at]])
    before = np.zeros(n + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    out_starts = before[starts]
    same = np.append(False, (out[1:] == out[:-1])) & ~new_row & (~begins | (lk != 1)) & (stop == 0)
    return *kept(out, out_starts, ~same), begins[~same], stop[~same], alone[~same]


def symbols_of(cp: np.ndarray, starts: np.ndarray, groups: tuple[str, ...] = ()):
    """(rows, symbols, first and last character of each word among the skeleton's, the skeleton) of canonical texts: word classes with the gaps between them; None where there are none."""
    cp, starts, begins, stop, alone = skeletons(cp, starts)
    if not len(cp):
        return None
    first, last, kind = lexicon(groups).find(cp, starts)
    if not len(first):
        return None
    latin = kinds()[1][cp] == 1
    latin |= cp == ord(WILD)
    row = rows_of(starts)
    ends_word = np.append(begins[1:] | ~latin[1:] | (row[1:] != row[:-1]), True)
    # among letters that stand alone no one can see where a word ends: "a c.l.o.w.n"
    fits = (~latin[first] | begins[first] | alone[first]) & (~latin[last] | ends_word[last] | alone[last])
    first, last, kind = first[fits], last[fits], kind[fits]
    order = np.lexsort((-last, first))
    first, last, kind = first[order], last[order], kind[order]
    reach = np.maximum.accumulate(last)
    outer = np.append(-1, reach[:-1]) < last
    first, last, kind = first[outer], last[outer], kind[outer]
    if not len(first):
        return None
    # the row of symbols: each word, and before it the gap to the word before it in the same text
    r = row[first]
    new = np.append(True, r[1:] != r[:-1])
    previous = np.append(0, last[:-1])
    size = np.where(new, 0, np.maximum(first - previous - 1, 0))
    # Latin words count as one where it is asked whether a gap is too wide for any clause
    units = np.cumsum(begins | ~latin)
    units = np.where(new, 0, units[np.maximum(first - 1, 0)] - units[previous])
    padded = np.append(stop, 0)
    bounds = np.empty(2 * len(first), np.int64)
    bounds[0::2], bounds[1::2] = np.minimum(np.where(new, first, previous + 1), first), first + 1
    strongest = np.maximum.reduceat(padded, bounds)[0::2]
    gap = np.select([new, strongest == 4, units > 12, size > 6, size > 2, size > 0], [-1, SYMBOL["BREAK"], SYMBOL["FAR"], SYMBOL["G12"], SYMBOL["G6"], SYMBOL["G2"]], -1)
    comma = np.where(~new & (strongest == 3), SYMBOL["COMMA"], -1)
    symbols = np.stack([comma, gap, kind], 1).ravel()
    return np.repeat(r, 3)[symbols >= 0], symbols[symbols >= 0], (r, first, last, kind), (cp, starts)


def score_points(cp: np.ndarray, starts: np.ndarray, groups: tuple[str, ...] = ()) -> np.ndarray:
    """Scores of canonical texts, a row each, a column for each label."""
    rows = len(starts) - 1
    found = symbols_of(cp, starts, groups)
    if found is None:
        return np.zeros((rows, len(LABELS)))
    text, symbols, *_ = found
    return grammar().best(symbols, np.searchsorted(text, np.arange(rows + 1)))


def group_names(labelled: Iterable[tuple[str, str]], *, category: str = "hate", least: int = 3) -> tuple[str, ...]:
    """Names of groups in labelled texts (text, category): what stands where a group does, in at least least texts of the category.

    The place of a group is beside a word of DEHUMAN, WORTHLESS, LEAVE or PURGE, in the same clause: the Latin word or the stretch
    of other characters before it, or behind a word of PURGE, without the words of other classes and particles. A name
    must be there with two such words at least, and more often than not its stretches of the category are such places.
    For a few thousand texts; what it gives is a parameter of the scores.
    """
    texts = [t for t, c in labelled if c == category and t]
    seen: dict[str, set] = {}
    count: dict[str, int] = {}
    after, before = {SYMBOL["PURGE"]}, {SYMBOL[x] for x in ("DEHUMAN", "WORTHLESS", "LEAVE", "PURGE")}
    data, offsets = texts_of(pa.array(texts, pa.string()))
    if not len(data):
        return ()
    cp, at = decode(data)
    found = symbols_of(*canonical_points(cp, at[offsets], tables()))
    if found is None:
        return ()
    _, _, (row, first, last, kind), (cp, starts) = found
    latin = kinds()[1][cp] == 1
    for i, k in enumerate(kind.tolist()):
        names = set()
        if k in before:
            lo = last[i - 1] + 1 if i and row[i - 1] == row[i] else starts[row[i]]
            names.add(_name(cp[lo : first[i]], latin[lo : first[i]], -1))
        if k in after:
            hi = first[i + 1] if i + 1 < len(row) and row[i + 1] == row[i] else starts[row[i] + 1]
            names.add(_name(cp[last[i] + 1 : hi], latin[last[i] + 1 : hi], 0))
        for name in names - {""}:
            count[name] = count.get(name, 0) + 1
            seen.setdefault(name, set()).add(cp[first[i] : last[i] + 1].tobytes())
    return tuple(sorted(n for n, c in count.items() if c >= least and len(seen[n]) > 1))


# Particles that may stand before a group's name.
PARTICLES = "把看见这些那些的了"


def _name(cp: np.ndarray, latin: np.ndarray, at: int) -> str:
    """The stretch of one kind of character at the start (0) or end (-1) of skeleton characters, without particles around it."""
    if not len(cp):
        return ""
    edge = np.flatnonzero(latin != latin[at])
    part = cp[edge[-1] + 1 if at and len(edge) else 0 : edge[0] if not at and len(edge) else len(cp)]
    name = "".join(map(chr, part.tolist())).strip(PARTICLES)
    return name if 3 <= len(name) <= 12 else ""


def score_array(array: pa.Array, groups: tuple[str, ...] = ()) -> pa.Array:
    """STRUCT<abuse, hate, sexual DOUBLE> of each text of a string array; groups: names of groups besides the general ones."""
    out = [np.zeros((0, len(LABELS)))]
    for part in chunks(array):
        data, offsets = texts_of(part)
        if len(data):
            cp, before = decode(data)
            out.append(score_points(*canonical_points(cp, before[offsets], tables()), groups))
        else:
            out.append(np.zeros((len(part), len(LABELS))))
    scores = np.concatenate(out)
    return pa.StructArray.from_arrays([pa.array(scores[:, i]) for i in range(len(LABELS))], [*LABELS])


def content_scores(text: Column, groups: tuple[str, ...] = ()) -> Column:
    """STRUCT<abuse, hate, sexual DOUBLE> from 0 to 1 of text; 0 for null and empty texts. groups: names of groups besides the general ones."""

    @arrow_udf(StructType([StructField(x, DoubleType()) for x in LABELS]))
    def scores(texts: pa.Array) -> pa.Array:
        return score_array(texts, groups)

    return scores(text)


def with_scores(df: DataFrame, text: str, groups: tuple[str, ...] = ()) -> DataFrame:
    """df with columns abuse, hate, sexual and score, the greatest of them. Columns of these names are replaced."""
    return df.withColumn("__scores", content_scores(F.col(text), groups)).withColumns({x: F.col(f"__scores.{x}") for x in LABELS}).drop("__scores").withColumn("score", F.greatest(*LABELS))


def rates(scored: DataFrame, by: str, *, threshold: float = THRESHOLD) -> DataFrame:
    """(by, texts, flagged, rate, and the rate of each label): a row for each value of by, null as well."""
    share = lambda c: F.avg((F.col(c) >= threshold).cast("double"))
    return scored.groupBy(by).agg(F.count(F.lit(1)).alias("texts"), F.count_if(F.col("score") >= threshold).alias("flagged"), share("score").alias("rate"), *(share(x).alias(f"{x}_rate") for x in LABELS))
