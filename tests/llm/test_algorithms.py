"""Parts of the operators that need no Spark, against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmark.llm import body, mih, mix, pack, quantile, spans, split


@given(st.lists(st.integers(-5, 5).map(float), max_size=12), st.sampled_from([0.0, 1.0, 3.0, 1e9]))
def test_best_runs_hold_the_best_run(scores, drop):
    runs = body.best_runs(scores, drop, 0.0)
    assert all(sum(scores[a:b]) > 0 and scores[a] > 0 and scores[b - 1] > 0 for a, b in runs)
    assert all(b <= c for (_, b), (c, _) in zip(runs, runs[1:]))
    inside = {i for a, b in runs for i in range(a, b)}
    assert {i for i, s in enumerate(scores) if s > 0} <= inside
    assert all(scores[i] >= -drop for i in inside)
    if drop > 1e6:
        best = max([0.0] + [sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)])
        assert max([0.0] + [sum(scores[a:b]) for a, b in runs]) == best


def test_doubtful_lines_stay_between_body_lines_and_scraps_go():
    assert body.best_runs([3, -0.5, 2, -4, 0.05, -4, 1], 1.0, 0.1) == [(0, 3), (6, 7)]
    assert body.best_runs([-1, 0.05, -1], 1.0, 0.1) == [(1, 2)]
    assert body.best_runs([]) == [] and body.best_runs([0.0, -1.0]) == []


def outside(text, title=None, site=()):
    return body.outside(text, title, dict.fromkeys(site, 2), body.second_weights([]), body.first_weights()[1])


def test_furniture_amid_and_around_the_body():
    text = "Home | About | Docs\nHome > A > Title\n\nThe body says one thing.\nPrint version\nIt says another thing too.\nForms of it:\n- first\n- second\nRelated pages\n» One title\n» Another title\nOnly the body goes on.\n© 2024 Somebody. All rights reserved."
    assert outside(text, "Title") == [0, 1, 4, 9, 10, 11, 13]
    assert outside("") == [] and outside("\r\n \t\n") == []
    assert outside("Copyright disputes around Orla ended.\nThe cookie jar test of Ibo compares 3 jars.") == []
    assert outside("A line.\nAnn: A motto of the site.\nB line.", None, ["Ann: A motto of the site."]) == [1]


@pytest.mark.xfail(reason="a short sentence of furniture words (related, by) scores below 0; the line filter before the learned weights kept it", strict=True)
def test_a_short_sentence_of_furniture_words():
    assert outside("Copyright disputes around Orla ended.\nThe cookie jar test of Ibo compares 3 jars.\nRelated work by Ann skipped it.") == []


# Pages whose wordings are not those of the labelled pages: - furniture, + body.
HELD_OUT = {
'en':("Keeping bees in town","""-Skip to article
-Home · Magazine · Podcasts · Search · Sign up
-Manage cookie preferences | Accept cookies
+Keeping bees in town
+A hive on a roof needs shade at noon and water within 50 metres, or the bees will visit the neighbour's pool.
-Share on Facebook
+Queens are marked with a dot of paint, blue in 2025 and white in 2026.
-Sign up for our weekly newsletter
+The honey of a good summer weighs 30 kilos; in a poor one it is best to leave it all to the bees.
-Popular articles
-* Choosing a smoker
-* Wax and what to do with it
-Leave a comment
-Comments (3)
-© 2025 Roof Garden Press. Terms of service | Privacy policy"""),
'de':("Brot ohne Hefe","""-Zum Hauptinhalt springen
-Startseite | Rezepte | Suche | Anmelden
+Brot ohne Hefe
+Der Teig ruht zwei Tage im Kühlen, dann kommt er für 40 Minuten in den Ofen.
-Artikel drucken
+Wer mag, mischt 100 g Nüsse darunter, aber erst nach der ersten Ruhe.
-Verwandte Artikel
-- Sauerteig pflegen
-- Welches Mehl wofür
-Kommentare (8)
-Newsletter abonnieren
-© 2024 Backstube Verlag. Datenschutz | Impressum"""),
'fr':("Tailler un pommier","""-Aller au menu
-Accueil | Jardin | Recherche | Connexion
+Tailler un pommier
+On taille en février, par temps sec, et l'on garde trois ou quatre branches autour du tronc.
-Partager cet article
+Une branche qui monte tout droit ne donne pas de fruits : on la coupe à deux yeux.
-Derniers billets du jardin
-- Le compost
-- Semer en mars
-Inscription à la lettre
-© 2023 Jardins. Tous droits réservés."""),
'es':("Cuidar un olivo","""-Ir al contenido
-Inicio | Huerto | Buscar | Entrar
+Cuidar un olivo
+El olivo quiere sol y poca agua; en invierno basta con regarlo cada tres semanas.
-Imprimir
+Las hojas grises por debajo son normales, no una plaga.
-Artículos más leídos
-- Podar en marzo
-- Aceitunas en sal
-Suscríbase
-© 2022 El Huerto. Aviso legal"""),
'zh':("种兰花","""-跳到主要内容
-首页 | 文章 | 搜索 | 登录
+种兰花
+兰花喜欢半阴，夏天每三天浇一次水，冬天少浇。
-分享
+换盆要在花谢以后，土里加三成树皮。
-热门文章
-- 修剪月季
-- 春天播种
-订阅
-© 2024 花园 版权所有"""),
}


def test_held_out_pages():
    """At most one line in five of the furniture stays, and one line in ten of the bodies goes."""
    kept = lost = furniture = good = 0
    for title, page in HELD_OUT.values():
        lines = page.split("\n")
        out = set(body.outside("\n".join(x[1:] for x in lines), title, {}, *body.first_weights()))
        for i, x in enumerate(lines):
            kept, furniture = kept + (x[0] == "-" and i not in out), furniture + (x[0] == "-")
            lost, good = lost + (x[0] == "+" and i in out), good + (x[0] == "+")
    assert furniture > 40 and kept <= furniture / 5 and lost <= good / 10
    known = {x for _, lines in body.labelled_pages((Path(body.__file__).parent / "labelled_pages.txt").read_text(encoding="utf-8")) for _, x in lines}
    assert sum(x[1:] in known for _, page in HELD_OUT.values() for x in page.split("\n")) <= furniture / 5


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=3000), st.integers(0, 3))
@settings(max_examples=30, deadline=None)
def test_collapsing_keeps_ranks_within_the_bound(values, cuts):
    k = 32
    parts = np.array_split(np.array(values), cuts + 1)
    sketches = [quantile.collapse([(1, np.sort(p[i : i + k - 1])) for i in range(0, len(p), k - 1)], k) for p in parts if len(p)]
    err, buffers = quantile.collapse([b for _, bs in sketches for b in bs], k, sum(e for e, _ in sketches))
    assert sum(w * len(v) for w, v in buffers) == len(values)
    ordered = np.sort(values)
    for p in (0.0, 0.05, 0.5, 0.95, 1.0):
        est, low, high = quantile._at(buffers, len(values), err, p)
        assert low <= np.quantile(ordered, p) + 1e-6 and np.quantile(ordered, p) <= high + 1e-6
        assert low <= est <= high
    if len(values) < k and cuts == 0:
        assert err == 0 and quantile._at(buffers, len(values), err, 0.5)[0] == pytest.approx(np.quantile(ordered, 0.5))


TEXTS = st.text(st.sampled_from("ab \n.。x"), max_size=400)


@given(TEXTS, st.integers(10, 60), st.integers(0, 9))
@settings(max_examples=300, deadline=None)
def test_pieces_join_to_the_text(text, limit, overlap):
    ends, forced = split.cuts(text, limit, overlap)
    starts = [0, *ends[:-1]]
    assert "".join(text[a:b] for a, b in zip(starts, ends)) == text
    assert all(b - a <= limit for a, b in zip(starts, ends))
    longest = max((len(r) for r in "".join(" " if c in split.STRENGTH else c for c in text).split()), default=0)
    assert any(forced) == (len(text) > limit and longest > limit)


def test_a_run_of_exactly_the_limit_is_not_forced():
    assert split.cuts("a" * 1200 + " " + "b" * 30)[1] == [False] * len(split.cuts("a" * 1200 + " " + "b" * 30)[0])
    assert any(split.cuts("a" * 1201 + " b")[1])


@given(st.dictionaries(st.integers(1, 40), st.integers(1, 30), max_size=20))
@settings(max_examples=100, deadline=None)
def test_packing_plan_places_everything_within_capacity(counts):
    matches, containers = pack.plan(counts, 40)
    used = np.zeros(containers, dtype=int)
    placed = {}
    for size, rank, first, n in matches:
        used[first : first + n] += size
        assert placed.get(size, 0) == rank
        placed[size] = rank + n
    assert placed == {s: n for s, n in counts.items() if n}
    assert containers == 0 or (used.max() <= 40 and used.min() > 0)
    assert containers <= 2 * -(-sum(s * n for s, n in counts.items()) // 40) + 1


def test_packing_plan_is_tight_on_many_items():
    rng = np.random.default_rng(1)
    sizes, n = np.unique(np.minimum(rng.geometric(1 / 400, 20_000), 2048), return_counts=True)
    counts = dict(zip(sizes.tolist(), n.tolist()))
    _, containers = pack.plan(counts)
    assert sum(s * k for s, k in counts.items()) / (containers * 2048) > 0.99
    with pytest.raises(ValueError):
        pack.plan({41: 1}, 40)


def test_water_filling():
    given_ = mix.water_fill({"a": 0.5, "b": 0.3, "c": 0.2}, {"a": 10, "b": 100, "c": 100}, {"a": 2, "b": 1, "c": 3}, 100)
    assert given_ == {"a": 20, "b": pytest.approx(48), "c": pytest.approx(32)}
    assert mix.water_fill({"a": 1.0}, {"a": 10}, {"a": 2}, 100) == {"a": 20}
    assert mix.water_fill({"a": 0.5, "b": 0.5}, {"a": 10}, {"a": 9, "b": 3}, 10) == {"a": 10, "b": 0}
    assert mix.water_fill({}, {}, {}, 10) == {}


@given(st.data())
@settings(max_examples=60, deadline=None)
def test_texts_that_share_a_span_choose_a_common_run(data):
    rng = random.Random(data.draw(st.integers(0, 1 << 30)))
    letters = rng.choice(["ab", "abcdefgh", "a"])
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = word(rng.randrange(40, 90))
    a, b = word(rng.randrange(60)) + shared + word(rng.randrange(60)), word(rng.randrange(60)) + shared + word(rng.randrange(60))
    t, place, h = spans.chosen([a, "xyz", b], 40, 16)
    one = {(int(x), a[p : p + 16]) for i, p, x in zip(t, place, h) if i == 0}
    two = {(int(x), b[p : p + 16]) for i, p, x in zip(t, place, h) if i == 2}
    assert one & two and 1 not in t


def test_window_minima_and_hashes():
    rng = np.random.default_rng(3)
    v = rng.integers(0, 1 << 60, 500).astype(np.uint64)
    assert (spans.window_minima(v, 37) == np.array([v[i : i + 37].min() for i in range(464)])).all()
    code = np.frombuffer(("ab" * 50).encode("utf-32-le"), dtype="<u4")
    h = spans.run_hashes(code, 10)
    assert len(set(h.tolist())) == 2 and len(h) == 91
    assert spans.common_prefix("abcd", "abxd") == 2 and spans.common_prefix("", "a") == 0 and spans.common_prefix("aa", "aab") == 2


def test_sentences_left():
    text = "One is here. Two is here.\nThree"
    assert spans.sentences_left(text, [(0, 12)]) == " Two is here.\nThree"
    assert spans.sentences_left(text, [(1, 30)]) == "One is here.e" or spans.sentences_left(text, [(1, 31)]) == "One is here."
    assert spans.sentences_left("", [(0, 1)]) == ""


def test_code_layout_and_learning():
    bits, tables = mih.layout(20_000)
    assert 8 <= bits <= 14 and tables > 8
    assert mih.layout(1)[0] == 6
    rng = np.random.default_rng(0)
    x = rng.standard_normal((300, 16))
    codes = mih.learn(x / np.linalg.norm(x, axis=1, keepdims=True), 300)
    assert codes.axes.shape[0] == 16 and codes.axes.shape[1] >= 192
    assert np.allclose(codes.axes[:, :16].T @ codes.axes[:, :16], np.eye(16), atol=1e-3)
    assert mih.learn(np.empty((0, 4)), 1).axes.shape[0] == 4
    crowd = x * 0.01 + 1
    assert mih.centre(crowd / np.linalg.norm(crowd, axis=1, keepdims=True))[1] == mih.AIM
    assert mih.centre(x / np.linalg.norm(x, axis=1, keepdims=True))[0].any()
