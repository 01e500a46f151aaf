"""Personal information in free text, found by anchors and local parsers.

An Aho-Corasick automaton finds anchors in one pass over a text: at-signs and
their spelled forms, digits, street words, titles and identifier cues. Around
each anchor a deterministic parser expands to the left and right as far as the
grammar of its kind allows, and validates what it has. Texts are folded one
character to one (full-width forms to ASCII), so places stay those of the
original.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Full-width forms U+FF01…U+FF5E, other spaces and dashes to ASCII, one to one.
_FOLD = {c: c - 0xFEE0 for c in range(0xFF01, 0xFF5F)} | {0x3000: 32, 0xA0: 32, 0x2010: 45, 0x2011: 45, 0x2012: 45, 0x2013: 45, 0x2212: 45, 0x2019: 39}

# Cue words and names of parts.

AT_SIGNS = ["@", "(at)", "[at]", "{at}", "골뱅이"]
DIGITS = list("0123456789")
STREET_WORDS = ["Street", "St", "Avenue", "Ave", "Boulevard", "Blvd", "Road", "Rd", "Lane", "Ln", "Crescent", "Cres", "Drive", "Dr", "Court", "Ct", "Place", "Pl", "Square", "Sq", "Terrace", "Ter", "Way", "Close", "Highway", "Hwy", "Parkway", "Pkwy"]
KO_TITLES = ["님", "씨", "과장", "대리", "부장", "차장", "팀장", "실장", "사원", "주임", "선임", "책임", "수석", "박사", "교수", "선생", "원장", "소장", "이사", "상무", "전무", "사장", "대표", "기자", "변호사", "간호사", "주무관", "연구원"]
KO_LABELS = ["수령인", "수신인", "신청자", "신청인", "작성자", "작성", "이름은", "이름", "성명", "성함은", "담당자", "예금주", "보호자", "고객명", "받는 사람", "보내는 사람"]
KO_OWNED = ["의 면허번호", "의 주민등록번호", "의 여권번호", "의 신분증", "의 연락처", "의 전화번호", "의 주소", "의 이메일", "의 메일", "의 휴대폰"]
EN_LABELS = ["name is", "name's", "Name:", "name:", "Applicant:", "applicant:", "Contact ", "Contact: ", "Written by", "written by", "Ship to", "ship to", "next to", "Attn:", "ATTN:", "Recipient:", "Dear ", "Signed,", "Author:", "Customer:", "Patient:", "Employee:", "Call ", "Ask ", "ask ", "Yesterday ", "yesterday ", "signed by", "told ", "met ", "from: ", "From: "]
#: Between a name and the group that it belongs to, and the groups.
SIGN_OFFS = ["Regards,", "regards,", "Sincerely,", "sincerely,", "Yours,", "Cheers,", "Best,", "Thanks,", "wishes,", "greetings,"]
#: Schemes whose rest is personal.
SCHEMES = ["mailto:", "tel:", "sms:", "callto:"]
#: Common given names: with a family name behind them they are anchors by themselves.
GIVEN = """James John Robert Michael William David Richard Joseph Thomas Charles Christopher Daniel Matthew Anthony Steven Paul Andrew Joshua Kenneth Kevin Brian George Edward Ronald Timothy Jason Jeffrey Ryan Jacob Gary Nicholas Eric Jonathan Stephen Larry Justin Scott Brandon Benjamin Samuel Gregory Frank Alexander Raymond Patrick Jack Dennis Jerry Tyler Aaron Jose Adam Nathan Henry Peter Bob Tom Jim Mike
    Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Lisa Nancy Betty Margaret Sandra Ashley Kimberly Emily Donna Michelle Carol Amanda Melissa Deborah Stephanie Rebecca Laura Helen Sharon Cynthia Kathleen Amy Angela Anna Ann Anne Brenda Pamela Emma Nicole Katherine Samantha Christine Rachel Janet Maria Diane Julie Alice Kate Jane Lucy
    Hans Peter Klaus Jürgen Wolfgang Stefan Thomas Ursula Monika Sabine Petra Jean Pierre Michel Philippe Marie Sophie Camille Juan Carlos Luis Javier Carmen Lucia Marco Giuseppe Giulia Ivan Olga Ahmed Mohammed Fatima Ali Wei Hiroshi Yuki""".split()
OF_GROUP = [" of the ", " of "]
GROUPS = ["team", "office", "board", "crew", "control", "desk", "department", "committee", "division", "unit", "staff", "council"]
EN_TITLES = ["Mr.", "Mrs.", "Ms.", "Mx.", "Dr.", "Prof.", "Mr ", "Mrs ", "Ms ", "Mx ", "Dr ", "Miss "]
JA_TITLES, ZH_TITLES = ["さん", "様", "氏"], ["先生", "女士", "小姐"]
ID_CUES = ["주민", "신분증", "면허", "여권", "외국인등록", "신청자", "신청인", "ID", "passport", "Passport", "licence", "license", "SSN", "social security", "national insurance", "lists", "身份证", "护照", "マイナンバー", "旅券"]
NOT_ID_CUES = ["주문", "접수", "사건", "빌드", "코드", "조각", "order", "ticket", "case", "build", "Build", "chunk", "invoice", "Order", "Ticket", "Case"]
SURNAMES = frozenset("김 이 박 최 정 강 조 윤 장 임 한 오 서 신 권 황 안 송 류 유 전 홍 고 문 양 손 배 백 허 남 심 노 하 곽 성 차 주 우 구 민 진 지 엄 채 원 천 방 공 현 함 변 염 여 추 도 소 석 선 설 마 길 연 위 표 명 기 반 라 왕 금 옥 육 인 맹 제 모 탁 국 어 은 편 용 예 경 봉 사 부 가 복 태 목 형 피 두 감 음 빈 동 온 호 범 좌 팽 승 간 상 시 갈 나 단 견 당 화 창 묵".split())
TWO_SURNAMES = frozenset("남궁 황보 제갈 사공 선우 서문 독고 동방 어금 망절 무본 황목".split())
NOT_NAMES = frozenset("고객 선생 회원 사장 부장 과장 대리 팀장 교수 박사 기사 주인 손님 장관 의원 원장 이사 대표 도련 공주 하나 부모 담당자 관리자 신청자 작성자 수령인 사용자 이용자 여러분 어르신 조상 선배 후배 기획자 감독 인사 정보 법무 총무 재무 편찬 현장 검색 주임 사원 이용 문의 전화".split())
TEAM_ENDS = ("팀", "실", "반", "위원회", "부서", "센터", "본부", "과")

_KO_WORD = re.compile(r"[가-힣]+")
_LATIN = r"(?:[A-Z]\.\s?){0,2}(?:(?:de|van|von|di) )?(?:[A-Z][A-Za-zÀ-ÿ]*['’]?[A-Za-zÀ-ÿ]*(?:-[A-Z][A-Za-zÀ-ÿ]+)?)(?: (?:[A-Z]\.|de|da|van|von|der|den|di|del|la|le|bin|al|[A-Z][A-Za-zÀ-ÿ]*['’]?[A-Za-zÀ-ÿ]+(?:-[A-Z][A-Za-zÀ-ÿ]+)?)){0,4}"
_NAME = re.compile(_LATIN)
_NAME_END = re.compile(rf"(?:^|(?<=[^A-Za-z.'’-]))(?:{_LATIN})\Z")
_LAST_FIRST = re.compile(r"(?:de |van |von )?[A-Z][A-Za-zÀ-ÿ'’-]+, (?!Flat|Apt|Unit|Suite|Floor|Room)[A-Z][A-Za-zÀ-ÿ'’-]+(?: [A-Z]\.)?(?=\s*(?:[<(;/.\n가-힣]|$|and\b|about\b|of the\b|, ?[가-힣]|[a-z]+ed\b|, \d|\d|, (?:Flat|P\.|PO)))")
_FULL = re.compile(r"([A-Z][a-zÀ-ÿ]+(?: [A-Z]\.)? (?:(?:de|van|von|del|la|di|O')\s?)?[A-Z][a-zÀ-ÿ]+(?:-[A-Z][a-zÀ-ÿ]+)?)(?= (?:[a-z]{2,}(?:ed|t)|has|is|was|said|will|can|paid|came|went|wrote|told|sent|and|or|who|works|lives) |, (?:who|our|my|the|a|born|aged)\b|[.,;] ?$|'s )")
#: Second words of places, schools and the like.
PLACES = frozenset("Street Road City County Park Hospital University College School Church Island Bay River Lake Hall House Museum Bridge Station Airport Hotel Court Square Prize Award Law Model Method Theorem Test Day".split())
_ORGS = frozenset("The Team Office Board Inc Ltd Co Corp Department Desk Help Support Service Services Center Centre Library Archive Portal Group Committee Street Road Lane Who What When Where Why How This That It He She They We You Of In On At For If As By Do No My Our And But Or Please See Not Each Some Between After Before During Nobody Approx Build Version Install Is Was Are Send Describe Which Her His Its".split())


@functools.cache
def _automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    kinds = {"scheme": SCHEMES, "sign": SIGN_OFFS, "given": [f"{w} " for w in GIVEN], "at": AT_SIGNS, "digit": DIGITS, "title": KO_TITLES + JA_TITLES + ZH_TITLES, "label": KO_LABELS, "owned": KO_OWNED, "en": EN_LABELS, "mr": EN_TITLES, "of": OF_GROUP}
    for kind, words in kinds.items():
        for w in words:
            a.add_word(w, (kind, len(w), w))
    a.make_automaton()
    return a


# E-mail addresses

_LOCAL = re.compile(r"[A-Za-z0-9._%+'-]+\Z")
_DOT = r"(?:\.| ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot )"
_DOMAIN = re.compile(rf"[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:{_DOT}[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+")


def _email(t: str, a: int, b: int) -> tuple[int, int] | None:
    left = a
    while left and t[left - 1] == " " and a - left < 2:
        left -= 1
    m = _LOCAL.search(t, max(0, left - 64), left)
    if not m:
        return None
    if "://" in t[max(0, m.start() - 64) : m.start()].rpartition(" ")[2]:
        return None  # user and password of an address in the net
    start = m.start()
    while start < left and t[start] in ".-'+%":
        start += 1
    right = b
    while right < len(t) and t[right] == " " and right - b < 2:
        right += 1
    d = _DOMAIN.match(t, right)
    if start >= left or not d or (left < a) != (right > b):
        return None
    host = re.split(_DOT, d.group())
    if len(host[-1]) < 2 or not host[-1].isalpha():
        return None
    return start, d.end()


# Telephone and identity numbers

_PHONES = [
    re.compile(r"\+82[-. ]?(?:\(0\)[-. ]?)?0?1[016789][-. ]?\d{3,4}[-. ]?\d{4}(?!\d)"),
    re.compile(r"\+82[-. ]?(?:\(0\)[-. ]?)?0?(?:2|[3-6]\d|70)[-. ]?\d{3,4}[-. ]?\d{4}(?!\d)"),
    re.compile(r"01[016789]([-. ]?)\d{3,4}\1\d{4}(?!\d)"),
    re.compile(r"\(0(?:2|[3-6]\d|70|50\d)\)[-. ]?\d{3,4}[-. ]?\d{4}(?!\d)"),
    re.compile(r"0(?:2|[3-6]\d|70|50\d)([-. ])\d{3,4}\1\d{4}(?!\d)"),
    re.compile(r"\+1[-. ]?\(?[2-9]\d\d\)?[-. ]?\d{3}[-. ]?\d{4}(?!\d)"),
    re.compile(r"\([2-9]\d\d\)[-. ]?\d{3}[-. ]\d{4}(?!\d)"),
    re.compile(r"[2-9]\d\d([-. ])\d{3}\1\d{4}(?!\d)"),
    re.compile(r"\+44[-. ]?(?:\(0\)[-. ]?)?\d{2,4}[-. ]?\d{3,4}[-. ]?\d{3,4}(?!\d)"),
    re.compile(r"0(?:20[-. ]\d{4}[-. ]\d{4}|1\d{2,3}[-. ]\d{3}[-. ]?\d{3,4}|7\d{3}[-. ]\d{3}[-. ]?\d{3})(?!\d)"),
    re.compile(r"0(?:[1-9]0|[1-9]|[1-9]\d)-\d{3,4}-\d{4}(?!\d)"),
    re.compile(r"(?:\+86[-. ]?)?1[3-9]\d([-. ]?)\d{4}\1\d{4}(?!\d)"),
    re.compile(r"\+\d{1,3}(?:[-. ]?\(?\d{1,4}\)?){2,5}(?!\d)"),
]
_IDS = [
    re.compile(r"\d\d(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])(?: ?- ?| )?[1-8]\d{6}(?![\d-])"),
    re.compile(r"\d{2}-\d{2}-\d{6}-\d{2}(?![\d-])"),
    re.compile(r"\d{3}-\d{2}-\d{4}(?![\d-])"),
    re.compile(r"[1-6]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx](?!\d)"),
]
_SSN, _NO_SSN = _IDS[2], re.compile(r"000|\d{3}-00|\d{3}-\d\d-0000")
_LETTER_IDS = [re.compile(r"[A-Z]{1,2}\d{7,8}(?![\dA-Za-z_-])"), re.compile(r"[A-Z]{2} ?\d\d ?\d\d ?\d\d ?[A-D](?![A-Za-z\d])")]


def _number(t: str, at: int) -> tuple[int, int, str] | None:
    """The telephone or identity number whose first digit is at ``at``."""
    before = t[at - 1] if at else " "
    if before in "_@#/\\=" and before not in "=/" or (before in ".,-" and at > 1 and t[at - 2].isalnum()):
        return None
    # An identity number that opens with letters.
    for m in (p.match(t, s) for s in (at - 1, at - 2, at - 3) if s >= 0 for p in _LETTER_IDS):
        if m and m.start() < at and not (m.start() and (t[m.start() - 1].isascii() and (t[m.start() - 1].isalnum() or t[m.start() - 1] in "_-#"))):
            near = t[max(0, m.start() - 44) : m.start()]
            if "lists" in t[max(0, m.start() - 8) : m.start()] or (any(c in near for c in ID_CUES) and not any(near.endswith(c + e) for c in NOT_ID_CUES for e in (" ", ": ", " is ", "는 ", "은 ", "번호는 ", " 번호는 ", " number is ", " no. "))):
                return m.start(), m.end(), "id_number"
    if (iban := _iban(t, at)) is not None:
        return iban
    if before.isdigit() or (before.isascii() and before.isupper()):
        return None
    for p in _IDS:
        m = p.match(t, at)
        if m and not _tail(t, m.end()) and not (m.re is _SSN and _NO_SSN.match(m.group())):
            return at, m.end(), "id_number"
    if (m := _CARD.match(t, at)) and luhn(re.sub(r"\D", "", m.group())):
        return at, m.end(), "id_number"
    starts = [at]
    if before == "+":
        starts = [at - 1]
    elif before == "(" and at > 0:
        starts = [at - 1, at]
    for s in starts:
        for p in _PHONES:
            m = p.match(t, s)
            if m and not _tail(t, m.end()):
                digits = sum(c.isdigit() for c in m.group())
                if 8 <= digits <= 15:
                    end = m.end()
                    if m.group().count("(") > m.group().count(")"):
                        continue
                    return s, end, "phone"
    return None


_CARD = re.compile(r"[2-6]\d{3}(?:([ -]?)\d{4}\1\d{4}\1\d{4}(?:\1\d{3})?|([ -]?)\d{6}\2\d{5})(?![\d-])")
_IBAN = re.compile(r"[A-Z]{2}\d\d(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")


def luhn(digits: str) -> bool:
    """Whether the check digit of a card number is right."""
    return sum(sum(divmod(2 * int(c), 10)) if k % 2 else int(c) for k, c in enumerate(reversed(digits))) % 10 == 0


def mod97(account: str) -> bool:
    """Whether the check digits of an international account number are right."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def _iban(t: str, at: int) -> tuple[int, int, str] | None:
    """The international account number whose first digit is at ``at``, by its check digits."""
    if at > 1 and (m := _IBAN.match(t, at - 2)) and not (at > 2 and t[at - 3].isalnum()):
        for end in range(m.end(), at + 11, -1):  # words in capitals may follow
            body = t[at - 2 : end].replace(" ", "")
            if t[end - 1] != " " and 15 <= len(body) <= 34 and mod97(body):
                return at - 2, end, "id_number"
    return None


def _tail(t: str, end: int) -> bool:
    """Whether a number goes on after ``end``, so that it is another kind of number."""
    rest = t[end : end + 2]
    return bool(rest) and (rest[0] == "_" or (rest[0] in "-./" and rest[1:].isdigit()) or (rest[0].isascii() and rest[0].isupper()))


# Postal addresses

_KO_UNIT = r"(?:,?\s?(?:지하\s?)?\d{1,4}동(?=\s?\d))?(?:,?\s?(?:지하\s?)?\d{1,3}층)?(?:,?\s?\d{1,5}호)?"
_KO_ADDRESS = re.compile(
    r"(?:\(?(?:우편번호\s?|우\)?\s?)?\d{5}\)?,?\s)?"
    r"(?:[가-힣]{1,8}(?:특별자치도|특별자치시|특별시|광역시|도|시)\s){0,2}(?:[가-힣]{1,8}(?:시|군|구)\s){0,2}(?:[가-힣]{1,8}(?:읍|면)\s)?"
    r"(?:[가-힣]{1,10}(?:대로|로|길)(?:\s?\d{1,4}(?:번)?길)?\s(?:지하\s?)?\d{1,5}(?:-\d{1,4})?(?:번지)?|[가-힣]{1,8}(?:동|리|가)\s(?:산\s?)?\d{1,5}(?:-\d{1,4})?(?:번지)?)" + _KO_UNIT + r"(?:\s?\([가-힣0-9, ]{2,20}동(?:, ?[가-힣A-Za-z0-9 ]{2,20})?\))?(?:,?\s\(?(?:우\s?)?\d{5}\)?(?!\d))?"
)
_KO_REGION = re.compile(r"(?:도|시|군|구)\s")
_STREET = "(?:" + "|".join(sorted(STREET_WORDS, key=len, reverse=True)) + r")\b\.?"
_TOWN = r"[A-Z][a-z]+(?:[ -][A-Z][a-z]+){0,2}"
_POST = r"(?: (?:[A-Z]{2} )?\d{5}(?:-\d{4})?(?!\d)| [A-Z]{1,2}\d[A-Z\d]? \d[A-Z]{2}\b|,? [A-Z]{2}(?: \d{5})?(?![A-Za-z\d]))?"
_EN_UNIT = r"(?:Apt|Apartment|Unit|Suite|Ste|Flat|Floor|Room|Rm|No)\.? ?#?\d{1,5}[A-Z]?|#\d{1,5}[A-Z]?|\d{1,3}(?:st|nd|rd|th) [Ff]loor|[Ff]loor \d{1,3}"
_EN_ADDRESS = re.compile(
    rf"(?:(?:{_EN_UNIT}),? )?(?:\d{{1,6}}[A-Z]?(?:-\d{{1,5}})? (?:[NSEW]\.? )?[A-Z][A-Za-z'’]+(?:[ -][A-Z][A-Za-z'’]+){{0,3}}? {_STREET}|P\.? ?O\.? ?Box \d{{1,6}})(?:,? (?:{_EN_UNIT}))*(?:, (?!Apt|Flat|Unit)(?:{_TOWN}){_POST})?(?:, (?:{_TOWN}){_POST})?"
)
_EN_START = re.compile(r"(?:Apt|Apartment|Unit|Suite|Flat|Floor|Room)\.? ?#?\Z|P\.? ?O\.? ?Box \Z")


_ABROAD = [
    # Japanese: postal code, prefecture, municipality, block numbers, building.
    re.compile(r"(?:〒? ?\d{3}-\d{4} ?)?(?:東京都|北海道|京都府|大阪府|[一-鿿]{2,3}県)[一-鿿ぁ-んァ-ヶ]{1,10}?[市区町村郡][一-鿿ぁ-んァ-ヶヶノ]{0,14}\d{1,4}(?:(?:丁目|番地?|号|[-ー]) ?\d{1,4}(?:番地?|号)?)*(?:丁目|番地?|号)?(?: ?[一-鿿ァ-ヶー]{2,12}\d{1,4}(?:号室|階))?"),
    # Chinese: province, city, district, street, number, building, unit, room, postal code.
    re.compile(r"(?:(?:(?![是在址于住为到从往的了])[一-鿿]){2,3}(?:省|自治区))?(?:(?:(?![是在址于住为到从往的了])[一-鿿]){2,4}市)(?:[一-鿿]{1,4}[区县镇]){0,2}[一-鿿]{1,8}?(?:大街|大道|路|街|巷|胡同|弄)\d{1,5}(?:弄\d{1,4})?号(?:院)?(?:\d{1,4}(?:号楼|栋|幢|座|楼))?(?:\d{1,3}单元)?(?:\d{1,5}室)?(?: ?\d{6}(?!\d))?"),
    # German: street and number, postal code and town.
    re.compile(r"(?:[A-ZÄÖÜ][a-zäöüß]+[- ])?[A-ZÄÖÜ][a-zäöüß-]*(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer|Straße|Allee|Platz) \d{1,4} ?[a-h]?(?![A-Za-z\d])(?:, (?:\d{1,2}\. (?:OG|Stock|Etage), )?\d{5} [A-ZÄÖÜ][a-zäöüß]+(?:[- ][A-ZÄÖÜ][a-zäöüß]+)?)?"),
    # French, Spanish, Italian: number and street or street and number, postal code and town.
    re.compile(r"\d{1,4}(?: ?(?:bis|ter))?,? (?:rue|avenue|boulevard|place|chemin|allée|quai|impasse) (?:(?:de|du|des|la|le|les|de la|l'|d'|de l')\s?){0,2}[A-ZÀ-Þ][\wÀ-ÿ'-]+(?:[ -][A-ZÀ-Þ][\wÀ-ÿ'-]+){0,3}(?:, \d{5} [A-ZÀ-Þ][\wÀ-ÿ'-]+(?:[ -][A-ZÀ-Þ][\wÀ-ÿ'-]+)?)?"),
    re.compile(r"(?:[Cc]alle|Avenida|Plaza|Paseo|Via|Viale|Piazza|Corso) (?:(?:de|del|la|las|los|di|della|delle|dei) ){0,2}[A-ZÀ-Þ][\wÀ-ÿ'-]+(?: [A-ZÀ-Þ][\wÀ-ÿ'-]+){0,3},? \d{1,4}(?!\d)(?:, (?:\d{5} )?[A-ZÀ-Þ][\wÀ-ÿ'-]+)?"),
]
_ABROAD_CUE = re.compile(r"[市区町村郡県府都省県路街道巷弄号]|straße|strasse|str\.|weg |platz|allee|gasse|ring |damm|ufer|Straße|Allee|Platz|rue |avenue |boulevard |place |chemin |quai |impasse |[Cc]alle |Avenida |Plaza |Paseo |Via |Viale |Piazza |Corso ")


def _abroad(t: str, at: int) -> tuple[int, int] | None:
    """The address of another country around the number at ``at``, from the start of its line or 40 characters before."""
    low = max(t.rfind("\n", 0, at) + 1, at - 40)
    if not _ABROAD_CUE.search(t, low, at + 24):
        return None
    for p in _ABROAD:
        for m in p.finditer(t, low):
            if m.start() > at:
                break
            if m.start() <= at < m.end():
                return m.span()
    return None


def _address(t: str, at: int) -> tuple[int, int] | None:
    """The address around the number at ``at``: of a street, a lot, a box, or a unit before it."""
    # English: from the number, its unit word or box word on.
    m = _EN_START.search(t, max(0, at - 12), at)
    for s in ([m.start()] if m else []) + [at]:
        m = _EN_ADDRESS.match(t, s)
        if m and not (s and (t[s - 1].isalnum() or t[s - 1] in "_-.")):
            end = m.end()
            if t[end - 1] == "." and (end >= len(t) or t[end : end + 1].isspace()) and not re.search(r"\b(?:St|Ave|Blvd|Rd|Ln|Cres|Dr|Ct|Pl|Sq|Ter|Hwy|Pkwy)\.\Z", t[s:end]):
                end -= 1
            return s, end
    # Korean: the number follows a street, a lot or 산; its regions stand before.
    line = max(t.rfind("\n", 0, at), at - 60)
    head = t[line + 1 : at]
    m = re.search(r"(?:(?:대로|로|길|동|리|가)\s(?:지하\s?|산\s?)?|[로길])\Z", head)
    if not m:
        return None
    words = [x.start() for x in re.finditer(r"(?:^|(?<=[\s(<\"'“‘,:;/]))(?=[가-힣(\d])", head)]
    best = None
    for w in reversed(words[-7:]):
        a = _KO_ADDRESS.match(t, line + 1 + w)
        if a and a.end() > at and a.start() <= at:
            if _KO_REGION.search(a.group()[: at - a.start()]) or re.search(r"\d", a.group()):
                best = (a.start(), a.end())
        elif best:
            break
    if not best:
        return None
    s, e = best
    text = t[s:e]
    if not _KO_REGION.search(text):
        return None
    if text[0] == "(" and ")" not in text:
        s += 1
    while e > s and t[e - 1] in " ,":
        e -= 1
    return s, e


# Names

_GIVEN = re.compile(r"[가-힣]{1,3}\Z")


def ko_name(word: str, short: bool = False) -> bool:
    """Whether a Hangul word is built as a Korean name: a surname and one or two syllables."""
    if word in NOT_NAMES or word.endswith(TEAM_ENDS):
        return False
    if word[:2] in TWO_SURNAMES and 3 <= len(word) <= 4:
        return True
    return word[:1] in SURNAMES and (len(word) == 3 or (short and len(word) == 2))


def _latin_name(t: str, at: int) -> tuple[int, int] | None:
    m = _LAST_FIRST.match(t, at)
    if m:
        return m.span()
    m = _NAME.match(t, at)
    if not m:
        return None
    words = m.group().split(" ")
    while words and (words[-1] in ("de", "da", "van", "von", "der", "den", "di", "del", "la", "le", "bin", "al") or words[-1] in _ORGS):
        words.pop()
    for i, w in enumerate(words):
        if w in _ORGS:
            words = words[:i]
            break
    if words and len(words) == 1 and "." in words[0] and (m := re.compile(r"[A-Z]\. (?:de|da|van|von|der|den|di|del|la|le|al) [A-Z][A-Za-zÀ-ÿ'’-]+").match(t, at)):
        return m.span()
    if not words or (len(words) == 1 and ("." in words[0] or len(words[0]) < 2)):
        return None
    return at, at + len(" ".join(words))


def _names(t: str, kind: str, a: int, b: int, word: str) -> Iterator[tuple[int, int]]:
    if kind == "given":
        if (a and (t[a - 1].isalnum() or t[a - 1] in "-'.")) or re.search(r"(?<!\.) [A-Z][a-z]+ \Z|^[A-Z][a-z]+ \Z", t[max(0, a - 24) : a]):
            return
        # A person does or owns something, or stands between others; a place or a product is named otherwise.
        m = _FULL.match(t, a)
        if m and not any(w in _ORGS or w in PLACES for w in m.group(1).split(" ")):
            yield m.span(1)
    elif kind == "sign":
        m = re.compile(r"[ \t]*\n\s*").match(t, b)
        if m and (s := _latin_name(t, m.end())) is not None and " " in t[s[0] : s[1]] and re.match(r"\s*(?:\n|,|$)", t[s[1] : s[1] + 3]):
            yield s
    elif kind == "title":
        if word == "씨" or word == "님":
            rest = t[b : b + 2]
            follows = re.match(r"(?:[^가-힣]|[와가는를의도께에이라만랑한]|$)", rest)
            if not follows or (word == "씨" and rest[:1] == "앗"):
                return
        left = a - 1 if a and t[a - 1] == " " else a
        m = re.search(r"[가-힣]+\Z", t[max(0, left - 8) : left])
        if m:
            own = m.group()
            start = left - len(own)
            if ko_name(own) and (start == 0 or not t[start - 1].isalnum()):
                yield start, left
                return
            if word in ("さん", "様", "氏") and left == a:
                return
        if word in JA_TITLES or word in ZH_TITLES:
            m = re.search(r"(?:^|(?<=[^一-鿿ァ-ヶーぁ-ん]))(?:[一-鿿]{2,4}|[ァ-ヶー]{2,10})\Z", t[max(0, a - 12) : a])
            if m and (word not in ("氏", "先生") or len(m.group()) >= 2):
                yield a - len(m.group()), a
            return
        m = _NAME_END.search(t[max(0, left - 48) : left])
        if m and len(m.group()) > 2:
            start = left - len(m.group())
            words = m.group().split(" ")
            skip = 0
            while skip < len(words) - 1 and words[skip] in _ORGS:
                skip += 1
            start += sum(len(w) + 1 for w in words[:skip])
            last = re.search(r"(?<![A-Za-zÀ-ÿ.'’-])[A-Z][A-Za-zÀ-ÿ'’-]+, \Z", t[max(0, start - 30) : start])
            if last and last.group()[:-2] not in _ORGS and " " not in t[start:left]:
                start -= len(last.group())
            yield start, left
    elif kind == "label":
        m = re.compile(r"(?:은|는|:|：|=)?\s*").match(t, b)
        at = m.end()
        if word in ("작성", "작성자", "이름", "성명") and not re.match(r" ?[:：=]", t[b : b + 2]):
            return
        m = _KO_WORD.match(t, at)
        if m:
            own = m.group()
            for n in (4, 3, 2):
                tail = own[n:]
                if word == "담당자" and not re.match(r"(?:입니다|이고|이며|이라고|예요|이에요)", tail) and not re.match(r" ?[:：=]", t[b : b + 2]):
                    continue
                if len(own) >= n and ko_name(own[:n], short=word != "담당자") and (tail == "" or re.fullmatch(r"(?:입니다|이고|이며|이라고|예요|이에요|님|씨|이다|이|가|은|는|과|와|께|에게|의)", tail)):
                    yield at, at + n
                    return
        elif (s := _latin_name(t, at)) is not None:
            yield s
    elif kind == "owned":
        m = re.search(r"[가-힣]+\Z", t[max(0, a - 8) : a])
        if m:
            if ko_name(m.group(), short=False):
                yield a - len(m.group()), a
        else:
            head = t[max(0, a - 48) : a]
            m = re.search(r"(?<![A-Za-zÀ-ÿ.'’-])[A-Z][A-Za-zÀ-ÿ'’-]+, [A-Z][A-Za-zÀ-ÿ'’-]+\Z", head) or _NAME_END.search(head)
            if m and len(m.group()) > 2:
                yield a - len(m.group()), a
    elif kind in ("en", "mr"):
        if a and t[a - 1].isalnum() and t[a - 1].isascii():
            return
        at = b
        while at < len(t) and t[at] in " \t":
            at += 1
        if word == "next to" and not re.search(r"\d ?[A-Z]? \Z", t[max(0, a - 4) : a]):
            return
        if word in ("Call ", "Ask ", "ask ", "told ", "met ", "Yesterday ", "yesterday "):
            # Verbs take other objects too: two words, of which none is a common one, and what follows a person.
            s = _latin_name(t, at)
            if not s or " " not in t[s[0] : s[1]] or not re.match(r" ?[(<]|,? (?:on|at|about|for|to|if|and|or|who|that|with) |[.,;?!]| [a-z]+ed ", t[s[1] : s[1] + 14]):
                return
        h = _KO_WORD.match(t, at)
        if h and ko_name(h.group(), short=True):
            yield h.span()
        elif (s := _latin_name(t, at)) is not None:
            yield s
            # A second person joined to the first.
            if (m := re.compile(r" (?:and|&) (?=[A-Z])").match(t, s[1])) and (s := _latin_name(t, m.end())) is not None and " " in t[s[0] : s[1]]:
                yield s
    elif kind == "of":
        if not re.match(r"(?:the )?(?:[a-z]+ ){0,3}(?:" + "|".join(GROUPS) + r")\b", t[b : b + 60]):
            return
        head = t[max(0, a - 60) : a]
        m = re.search(r"(?<![A-Za-zÀ-ÿ.'’-])[A-Z][A-Za-zÀ-ÿ'’-]+, [A-Z][A-Za-zÀ-ÿ'’-]+\Z", head)
        if m and not any(w.strip(",") in _ORGS for w in m.group().split(" ")):
            yield a - len(m.group()), a
            return
        m = _NAME_END.search(head)
        if m and " " in m.group():
            words, start = m.group().split(" "), a - len(m.group())
            while words and words[0] in _ORGS:
                start += len(words[0]) + 1
                words = words[1:]
            if len(words) > 1 and not any(w in _ORGS for w in words):
                yield start, a


def spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, type) of every span of personal information, in code points, in order, none overlapping."""
    if not text:
        return []
    t = text.translate(_FOLD)
    found: list[tuple[int, int, str]] = []
    after = -1
    for end, (kind, size, word) in _automaton().iter(t):
        a, b = end + 1 - size, end + 1
        if kind == "digit":
            if a < after or (a and t[a - 1].isdigit()):
                continue
            if (s := _number(t, a)) is not None:
                found.append(s)
                after = s[1]
            elif (p := _address(t, a) or _abroad(t, a)) is not None:
                found.append((*p, "address"))
                after = p[1]
        elif kind == "scheme":
            if word == "mailto:":
                continue  # its at-sign is the anchor
            m = re.compile(r"\+?\d[\d().-]{5,18}\d").match(t, b)
            if m and not (a and t[a - 1].isalnum()):
                found.append((*m.span(), "phone"))
                after = m.end()
        elif kind == "at":
            if (p := _email(t, a, b)) is not None:
                found.append((*p, "email"))
        else:
            found.extend((*p, "name") for p in _names(t, kind, a, b, word))
    rank = {"email": 0, "id_number": 1, "phone": 2, "address": 3, "name": 4}
    out: list[tuple[int, int, str]] = []  # in order and apart, so that only the neighbours of a new span can overlap it
    for s in sorted(set(found), key=lambda x: (rank[x[2]], x[0] - x[1], x[0])):
        k = bisect.bisect(out, s)
        if (not k or out[k - 1][1] <= s[0]) and (k == len(out) or out[k][0] >= s[1]):
            out.insert(k, s)
    return out


def redact(text: str | None) -> str | None:
    """The text with each span replaced by a placeholder of its type, such as ``[EMAIL]``; all else as it was."""
    if not text:
        return text
    out, at = [], 0
    for a, b, kind in spans(text):
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_FOUND = "log_id bigint, field_name string, ctx_no int, start_pos int, end_pos int, pii_type string"


def find(logs: DataFrame) -> DataFrame:
    """A row per span of logs (log_id, question, answer, contexts of structs with text): see ``_FOUND``.

    Null and empty fields have none; a log delivered twice counts once. Spans
    are found where the rows are read; only they are shuffled, to count once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows: list[tuple] = []
                for i, q, a, texts in zip(*(part.column(c).to_pylist() for c in ("log_id", "question", "answer", "_texts"))):
                    for field, no, text in [("question", -1, q), ("answer", -1, a), *(("contexts", k, x) for k, x in enumerate(texts or []))]:
                        rows += [(i, field, no, *s) for s in spans(text)]
                cells = list(zip(*rows)) or [()] * 6
                kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=[x.split()[0] for x in _FOUND.split(", ")])

    texts = F.transform("contexts", lambda x: x["text"]).alias("_texts")
    return logs.select("log_id", "question", "answer", texts).mapInArrow(run, _FOUND).distinct()


def redact_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """``df`` with the texts of ``columns`` (string, or array of structs with a text) redacted; nothing is shuffled."""

    @F.pandas_udf(T.StringType())
    def one(s):  # noqa: ANN001, ANN202
        return s.map(redact, na_action="ignore")

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def many(s):  # noqa: ANN001, ANN202
        return s.map(lambda x: None if x is None else [redact(t) for t in x])

    new = {}
    for c in columns:
        if dict(df.dtypes)[c] == "string":
            new[c] = one(F.col(c))
        else:
            texts = many(F.transform(c, lambda x: x["text"]))
            new[c] = F.zip_with(F.col(c), texts, lambda x, t: F.when(x.isNotNull(), x.withField("text", t)))
    return df.withColumns(new)
