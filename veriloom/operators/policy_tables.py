"""Fixed values of the evidence policy: categories, bases, phrases, markers, keywords, score ladders and fallback comments."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from veriloom.operators.policy import ladder_score, marker_score

# Fixed values, as the policy states them.

SUPPLEMENT, FLAMMABLE = "БАД", "Легковоспламеняющиеся"

#: Bases that a verdict of (category, label) may name, in order.
ALLOWED: dict[tuple[str, int], tuple[str, ...]] = {
    (SUPPLEMENT, 1): ("explicit_bad_status", "oral_dosed_supplement"),
    (SUPPLEMENT, 0): ("explicit_not_bad", "sport_nutrition", "ordinary_food", "external_product", "raw_or_carrier", "mushroom_product", "other_non_bad_product"),
    (FLAMMABLE, 1): ("sold_fuel", "ignition_source", "included_flammable_content", "pyrotechnic_article", "refillable_flame_device"),
    (FLAMMABLE, 0): ("device_only", "external_fuel_only", "accessory_only", "ordinary_object"),
}
#: Candidate A has no mushroom basis, and a phrase of its own for sport nutrition.
NOT_OF_A = "mushroom_product"

PHRASES = {
    "explicit_bad_status": "прямой статус БАД у продаваемого товара",
    "oral_dosed_supplement": "дозированную добавку для приёма внутрь",
    "explicit_not_bad": "прямое отрицание статуса БАД",
    "sport_nutrition": "прямо названный BCAA-, протеиновый или предтренировочный продукт",
    "ordinary_food": "то, что продаётся обычный пищевой продукт",
    "external_product": "наружное средство, а не добавку для приёма внутрь",
    "raw_or_carrier": "сырьё или носитель без самостоятельного статуса БАД",
    "mushroom_product": "прямо названный набор грибов или грибных экстрактов",
    "other_non_bad_product": "иной прямо названный тип продаваемого товара",
    "sold_fuel": "продаваемое топливо или горючий материал",
    "ignition_source": "самостоятельное средство розжига или источник огня",
    "included_flammable_content": "включённое в продаваемый комплект горючее содержимое",
    "pyrotechnic_article": "пиротехническое или дымовое изделие",
    "refillable_flame_device": "перезаправляемое устройство, создающее пламя",
    "device_only": "устройство, использующее внешний источник топлива",
    "external_fuel_only": "упоминание топлива лишь как внешнего условия применения",
    "accessory_only": "аксессуар или комплектующую без продаваемого горючего содержимого",
    "ordinary_object": "обычный предмет, а не продаваемое топливо или источник огня",
}
SPORT_PHRASE_OF_A = "то, что продаётся спортивное питание"

MARKERS = {
    "explicit_bad_status": ("бад", "supplement", "добавк", "биологически активн"),
    "oral_dosed_supplement": ("капсул", "таблет", "принимать", "приём", "дозиров"),
    "explicit_not_bad": ("не является бад", "не является биологически активной"),
    "sport_nutrition": ("спортивное питание", "bcaa", "бцаа", "протеин", "предтренировоч"),
    "ordinary_food": ("напиток", "сок", "чай", "кофе", "батончик", "конфет", "еда"),
    "external_product": ("наружн", "космет", "крем", "сыворотк", "мазь", "шампун"),
    "raw_or_carrier": ("сырь", "пуст", "капсул для", "оболочк", "носител"),
    "mushroom_product": ("гриб", "ежовик", "кордицепс", "траметес"),
    "other_non_bad_product": ("питьевой", "комплекс", "порошок", "масло", "экстракт"),
    "sold_fuel": ("сухое горючее", "топливо", "бензин", "горючий материал"),
    "ignition_source": ("спич", "розжиг", "зажигал"),
    "included_flammable_content": ("в комплект", "состав набора", "баллон в комплект"),
    "pyrotechnic_article": ("хлопуш", "дым", "пиротех", "фейервер"),
    "refillable_flame_device": ("перезаправ", "заправляем", "газовая зажигал"),
    "device_only": ("плита", "горелка", "устройство", "гриль"),
    "external_fuel_only": ("подключ", "баллон", "газовые смеси", "внешн"),
    "accessory_only": ("насадк", "переходник", "чехол", "крепеж", "комплектующ"),
    "ordinary_object": ("пистон", "держатель", "контейнер", "посуда", "решетка"),
}

KEYWORDS = {
    SUPPLEMENT: ("бад", "supplement", "добавк", "витамин", "капсул", "таблет", "приём", "пищ", "спорт", "наруж", "лекар"),
    FLAMMABLE: ("горюч", "огн", "плам", "топлив", "газ", "баллон", "спич", "розжиг", "зажиг", "свеч", "дым", "пиротех"),
}

#: Patterns with their points, the first that is found counts; a basis without a ladder has 3 for any marker.
_W = r"[\p{L}\p{N}_]"
LADDERS: dict[str, tuple[tuple[str, int], ...]] = {
    "explicit_bad_status": ((rf"биологически активн{_W}* добавк|пищев{_W}* добавк|бад к пище", 6), (rf"supplement|(?<!{_W})бад(?!{_W})", 4)),
    "explicit_not_bad": ((r"не является.{0,35}(?:бад|биологически активн)", 8),),
    "sport_nutrition": ((rf"спортивн{_W}* питан|(?<!{_W})(?:bcaa|бцаа)(?!{_W})|протеин|предтренировоч", 5),),
    "ordinary_food": ((rf"(?<!{_W})(?:напиток|сок|чай|кофе|батончик|конфета|еда)(?!{_W})", 4),),
    "sold_fuel": ((r"сухое горючее|топлив|бензин|горючий материал|угол[ья]|брикет", 6),),
    "ignition_source": ((rf"спич|набор.{{0,20}}розжиг|средств{_W}* розжиг|зажигал", 5),),
    "included_flammable_content": ((rf"(?=.*(?:в комплект|в состав.{{0,20}}набор))(?=.*(?:горюч|топлив|спич|газов{_W}* баллон|бензин))", 7),),
    "pyrotechnic_article": ((rf"хлопуш|дымовая шашка|цветн{_W}* дым|пиротех|фейервер|бенгальск|свеч{_W}* фонтан", 6),),
    "refillable_flame_device": ((r"перезаправ|заправляем|газовая зажигал", 6),),
    "device_only": ((r"плита|горелка|устройство|гриль", 5),),
}
ANY_MARKER = 3

FALLBACK = {
    (SUPPLEMENT, 1): "Карточка подтверждает соответствие правилам категории БАД; приоритетные исключения для спортивного питания или прямого отрицания не установлены.",
    (SUPPLEMENT, 0): "Карточка не подтверждает обязательную маркировку БАД либо содержит приоритетное исключение для спортивного питания или прямого отрицания.",
    (FLAMMABLE, 1): "Карточка подтверждает источник воспламенения, горючее вещество или газ либо отдельный легковоспламеняющийся предмет в комплекте.",
    (FLAMMABLE, 0): "Не подтверждены источник воспламенения, горючее содержимое или топливо в комплекте; пустая конструкция сама по себе не относится к категории.",
}


def allowed(category: str, label: int, candidate: str) -> tuple[str, ...]:
    return tuple(b for b in ALLOWED[category, label] if candidate != "A" or b != NOT_OF_A)


def phrase(basis: str, candidate: str) -> str:
    return SPORT_PHRASE_OF_A if candidate == "A" and basis == "sport_nutrition" else PHRASES[basis]


def scores(text: Column, bases: Sequence[str], candidate: str) -> dict[str, Column]:
    """Points of each basis for a folded piece of text: markers counted for candidate A, ladders for B."""
    if candidate == "A":
        return {b: marker_score(text, MARKERS[b]) for b in bases}
    return {b: ladder_score(text, LADDERS[b]) if b in LADDERS else F.when(marker_score(text, MARKERS[b]) > 0, ANY_MARKER).otherwise(0) for b in bases}
