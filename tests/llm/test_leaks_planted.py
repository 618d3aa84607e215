"""Planted items with numbers, units and names that no item holds, in five languages: recall and precision."""

import random
import textwrap

from trendloom.llm.leaks import reparameterised_items

# in each language: item texts with slots, then the items' own numbers, units and names, then fresh ones
TEXTS = {
    "en": (
        [
            "On market day {a} carried {n} {u} of lamp oil from the harbour to the mill, and by evening {b} had sold {m} {v} of it. How much was left for the keeper of the inn?",
            "A tank holds {n} {u} of water. When {a} opens the lower tap it loses {m} {v} every hour, while {b} pours in the same amount from the well behind the house. When is it empty?",
            "The road from the chapel to the bridge is {n} {u} long. If {a} walks the first half in {m} {v} and then waits for {b} at the gate, how long does the whole way take them?",
            "Every morning {a} weighs {n} {u} of flour for the bread and keeps {m} {v} aside for the cakes that {b} bakes on feast days. How much flour do they need in a week?",
        ],
        (["seven", "12", "forty", "9"], ["pints", "yards", "pounds"], ["Alice", "Robert", "Helen", "George"]),
        (["thirteen", "250", "3", "eighty"], ["firkins", "furlongs", "drams", "hogsheads"], ["Zuleika", "Oswin", "Thandiwe", "Quentin"]),
    ),
    "de": (
        [
            "Am Markttag trug {a} genau {n} {u} Öl vom Hafen zur Mühle, und bis zum Abend hatte {b} davon {m} {v} verkauft. Wie viel blieb für den alten Wirt noch übrig?",
            "In einem Becken stehen {n} {u} Wasser. Wenn {a} den unteren Hahn öffnet, verliert es jede Stunde {m} {v}, während {b} dieselbe Menge aus dem Brunnen hinter dem Haus nachgießt. Wann ist es leer?",
            "Der Weg von der Kapelle zur Brücke ist {n} {u} lang. Wenn {a} die erste Hälfte in {m} {v} geht und dann am Tor auf {b} wartet, wie lange brauchen beide für den ganzen Weg?",
            "Jeden Morgen wiegt {a} erst {n} {u} Mehl für das Brot und legt {m} {v} für die Kuchen zurück, die {b} an Festtagen backt. Wie viel Mehl brauchen sie in einer Woche?",
        ],
        (["sieben", "12", "vierzig", "9"], ["Krüge", "Ellen", "Pfund"], ["Anna", "Robert", "Helene", "Georg"]),
        (["dreizehn", "250", "3", "achtzig"], ["Scheffel", "Klafter", "Quentchen", "Malter"], ["Zuleika", "Oswin", "Thandiwe", "Quirin"]),
    ),
    "fr": (
        [
            "Le jour du marché {a} porta {n} {u} de vin du port jusqu'au moulin, et le soir venu {b} en avait vendu {m} {v} aux gens du village. Combien en restait-il pour le vieil aubergiste ?",
            "Un bassin contient {n} {u} de bonne eau. Quand {a} ouvre le robinet du bas, il perd {m} {v} par heure, tandis que {b} y verse autant du puits qui est derrière la maison. Quand sera-t-il vide ?",
            "Le chemin de la chapelle au pont fait {n} {u} de long. Si {a} parcourt la première moitié en {m} {v} et attend ensuite {b} devant la porte, combien de temps leur faut-il en tout ?",
            "Chaque matin {a} pèse {n} {u} de farine pour le pain et met {m} {v} de côté pour les gâteaux que {b} prépare les jours de fête. Combien de farine leur faut-il par semaine ?",
        ],
        (["sept", "12", "quarante", "9"], ["cruches", "aunes", "livres"], ["Alice", "Robert", "Hélène", "Georges"]),
        (["treize", "250", "3", "soixante"], ["muids", "toises", "onces", "setiers"], ["Zuleika", "Oswin", "Thandiwe", "Quentin"]),
    ),
    "es": (
        [
            "El día de mercado {a} llevó {n} {u} de aceite del puerto al molino, y por la tarde {b} ya había vendido {m} {v} a la gente del pueblo. ¿Cuánto quedó para el viejo posadero?",
            "Un depósito contiene {n} {u} de agua. Cuando {a} abre el grifo de abajo pierde {m} {v} cada hora, mientras {b} echa la misma cantidad desde el pozo que está detrás de la casa. ¿Cuándo se vacía?",
            "El camino de la capilla al puente mide {n} {u} de largo. Si {a} anda la primera mitad en {m} {v} y luego espera a {b} junto a la puerta, ¿cuánto tardan los dos en todo el camino?",
            "Cada mañana {a} pesa {n} {u} de harina para el pan y aparta {m} {v} para los pasteles que {b} hornea los días de fiesta. ¿Cuánta harina necesitan en una semana?",
        ],
        (["siete", "12", "cuarenta", "9"], ["cántaros", "varas", "libras"], ["Alicia", "Roberto", "Elena", "Jorge"]),
        (["trece", "250", "3", "ochenta"], ["arrobas", "leguas", "adarmes", "fanegas"], ["Zuleika", "Oswin", "Thandiwe", "Quintín"]),
    ),
    "ru": (
        [
            "В базарный день {a} отнёс {n} {u} масла из гавани на мельницу, а к вечеру {b} уже продал {m} {v} жителям соседней деревни. Сколько осталось для старого хозяина постоялого двора?",
            "В чане стоит {n} {u} воды. Когда {a} открывает нижний кран, уходит {m} {v} за час, а тем временем {b} доливает столько же из колодца за старым домом. Когда чан станет пустым?",
            "Дорога от часовни до моста тянется на {n} {u} вдоль реки. Если {a} пройдёт первую половину за {m} {v} и будет ждать у ворот, пока {b} догонит, сколько времени займёт у них весь путь?",
            "Каждое утро {a} отмеряет {n} {u} муки на хлеб и откладывает {m} {v} на пироги, которые {b} печёт по большим праздникам. Сколько муки им нужно на одну неделю?",
        ],
        (["семь", "12", "сорок", "9"], ["кувшинов", "локтей", "фунтов"], ["Анна", "Роман", "Елена", "Егор"]),
        (["тринадцать", "250", "3", "тридцать"], ["пудов", "аршинов", "золотников", "вёдер"], ["Зулейка", "Освальд", "Тамерлан", "Квинт"]),
    ),
}
SMALL = {"en": "grey old tall new late", "de": "grau spät neu froh still", "fr": "gris neuf tard haut calme", "es": "gris nuevo tarde alto quieto", "ru": "серый новый поздно тихий"}


def filled(text, values, rng):
    numbers, units, names = values
    n, m = rng.sample(numbers, 2)
    u, v = rng.sample(units, 2)
    a, b = rng.sample(names, 2)
    return text.format(n=n, m=m, u=u, v=v, a=a, b=b)


def planted(seed=4, copies=5):
    rng = random.Random(seed)
    items, docs, truth = [], [], set()
    for lang, (texts, own, fresh) in TEXTS.items():
        for text in texts:
            item = len(items)
            items.append((item, filled(text, own, rng)))
            for _ in range(copies):
                body = filled(text, fresh, rng)
                style = rng.random()
                if style < 0.3:
                    body = textwrap.fill(body, 60).replace("\n", "\n> ")
                elif style < 0.5:
                    body = body.replace("e", "е", 3)  # look-alikes
                truth.add((len(docs), item))
                docs.append((len(docs), f"Subject: x\n\n{rng.choice(SMALL[lang].split())}, {body} Bye."))
                # the same passage with every sixth word another one: no template of an item
                words = filled(text, fresh, rng).split()
                docs.append((len(docs), "Subject: y\n\n" + " ".join(rng.choice(SMALL[lang].split()) if k % 6 == 3 else w for k, w in enumerate(words))))
                # names and numbers in rows: templates of placeholders alone
                docs.append((len(docs), "Subject: z\n\nsee " + " ".join(f"{rng.choice(fresh[0])} {rng.choice(fresh[1])} {rng.choice(fresh[2])}" for _ in range(20))))
    return items, docs, truth


def test_recall_and_precision(spark):
    items, docs, truth = planted()
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in reparameterised_items(d, i).collect()}
    by_lang = {}
    for (doc, item) in truth:
        lang = list(TEXTS)[item // 4]
        hit, n = by_lang.get(lang, (0, 0))
        by_lang[lang] = (hit + ((doc, item) in found), n + 1)
    print(f"planted {len(truth)}, found {len(found)}, both {len(found & truth)}, by language {by_lang}")
    assert len(found & truth) >= 0.9 * len(truth)
    assert len(found & truth) >= 0.9 * len(found)
