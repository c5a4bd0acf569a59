"""Portuguese suffix stripping in eight ordered steps.

Run it over the distinct vocabulary and join the stems back: that takes the place of a cache.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import bind, stripped, without_accents

# The published rules of the RSLP stemmer. A line is a suffix, the least length of what remains, the
# replacement (- for none) and the words that the rule leaves alone. Within a step the first line that fits counts.
PLURAL = """
ns 1 m
ões 3 ão
ães 1 ão mães alemães
ais 1 al cais mais pais
éis 2 el
eis 2 el
óis 2 ol
is 2 il lápis cais mais crúcis biquínis pois depois dois leis seis
les 3 l
res 3 r árvores
s 2 - aliás pires lápis cais mais mas menos férias fezes pêsames crúcis gás atrás moisés através convés ês país após ambas ambos messias depois mês três
"""
FEMININE = """
ona 3 ão abandona lona iona cortisona monótona maratona acetona detona carona persona
ora 3 or
na 4 no carona abandona lona iona cortisona monótona maratona acetona detona guiana campana grana caravana banana paisana máquina página pessoana
inha 3 inho rainha linha minha campinha
esa 3 ês mesa obesa princesa turquesa ilesa pesa presa empresa defesa surpresa
osa 3 oso mucosa prosa
íaca 3 íaco
ica 3 ico dica música física lógica prática técnica política pública básica
ada 3 ado pitada entrada estrada chamada rodada
ida 3 ido vida dúvida medida saída guarida
ída 3 ido recaída saída dúvida
ima 3 imo vítima estima
iva 3 ivo saliva oliva deriva
eira 3 eiro beira cadeira frigideira bandeira feira capoeira barreira fronteira besteira poeira maneira carteira madeira
ã 2 ão amanhã arapuã fã divã
"""
ADVERB = """
mente 4 - experimente regimente elemente
"""
AUGMENTATIVE = """
díssimo 5 -
abilíssimo 5 -
íssimo 3 -
ésimo 3 -
érrimo 4 -
zinho 2 -
quinho 4 c
uinho 4 -
adinho 3 -
inho 3 - caminho cominho vizinho moinho
alhão 4 -
uça 4 -
aço 4 - antebraço
aça 4 -
adão 4 -
idão 4 -
ázio 3 - topázio
arraz 4 -
zarrão 3 -
arrão 4 -
arra 3 -
zão 2 - coração
ão 3 - camarão chimarrão canção coração embrião grotão glutão ficção fogão feijão divisão profissão vazão cão razão limão leão mamão sabão verão balão salão sertão irmão cristão alemão capitão pão chão mão não então bilhão milhão questão padrão versão tensão extensão dimensão precisão decisão conclusão inclusão exclusão difusão confusão revisão televisão visão missão comissão permissão transmissão admissão emissão pressão sessão expressão impressão compressão progressão agressão regressão depressão concessão sucessão
"""
NOMINAL = """
encialista 4 -
alista 5 -
agem 3 - coragem chantagem vantagem carruagem imagem viagem linguagem mensagem
iamento 4 -
amento 3 - firmamento fundamento departamento
imento 3 -
mento 6 - firmamento elemento complemento instrumento departamento documento argumento movimento momento
alizado 4 -
atizado 4 -
tizado 4 - alfabetizado
izado 5 - organizado pulverizado
ativo 4 - pejorativo relativo
tivo 4 - relativo
ivo 4 - passivo possessivo pejorativo positivo motivo objetivo arquivo
ado 2 - grado estado lado dado mercado resultado significado empregado
ido 3 - cândido consolido rápido decido líquido sólido válido conteúdo sentido partido pedido
ador 3 -
edor 3 -
idor 4 - ouvidor
dor 4 - ouvidor
sor 4 - assessor
atória 5 -
tor 3 - benfeitor leitor editor pastor produtor promotor consultor vetor setor fator motor
or 2 - motor melhor redor rigor sensor tambor tumor assessor benfeitor pastor favor autor valor calor amor cor dor flor maior menor pior senhor setor vetor fator
abilidade 5 -
icionista 4 -
cionista 5 -
ionista 5 -
ista 4 - batista vista lista revista conquista analista
aria 3 - maria varia
eiro 3 - desespero primeiro ligeiro barbeiro brasileiro cargueiro fronteiro dinheiro inteiro janeiro roteiro
uoso 3 -
oso 3 - precioso gostoso
aticidade 4 -
icidade 4 -
idade 4 - autoridade comunidade
dade 4 - autoridade comunidade oportunidade contabilidade reciprocidade
ivel 4 - possível
ível 4 - possível
ável 2 - afável razoável potável vulnerável
ência 3 -
ância 4 - ambulância
ncia 3 -
edouro 3 -
queiro 3 c
adeiro 4 - desfiladeiro
ário 3 - voluntário salário aniversário diário armário necessário usuário binário
oira 3 o
ério 6 -
ês 4 -
eza 3 -
ez 4 -
esco 4 -
ante 2 - gigante elefante adiante possante instante restaurante importante constante durante diante
ástico 4 - eclesiástico
ático 3 -
ico 4 - público básico físico clássico prático técnico único típico
ividade 5 -
ismo 3 - cinismo organismo mecanismo
ente 4 - acidente alimente presente ambiente cliente diferente eficiente gerente paciente recente
ense 5 -
inal 3 -
ano 4 - humano plano urbano oceano
ura 4 - imatura acupuntura costura estrutura cultura figura leitura natura
ural 4 -
ual 3 - bissexual virtual visual pontual atual manual anual casual
ial 3 - social especial material essencial inicial oficial parcial
al 4 - afinal animal estatal bissexual desleal fiscal formal pessoal liberal postal virtual visual pontual sideral sucursal digital total final local natural geral principal capital central global
"""
VERBAL = """
aríamos 3 -
eríamos 3 -
iríamos 3 -
ássemos 3 -
êssemos 3 -
íssemos 3 -
aríeis 3 -
eríeis 3 -
iríeis 3 -
ásseis 3 -
ésseis 3 -
ísseis 3 -
áramos 3 -
éramos 3 -
íramos 3 -
ávamos 3 -
aremos 3 -
eremos 3 -
iremos 3 -
ariam 3 -
eriam 3 -
iriam 3 -
assem 3 -
essem 3 -
issem 3 -
ando 2 -
endo 3 -
indo 3 -
ondo 3 -
aramos 3 -
eramos 3 -
iramos 3 -
arias 3 -
erias 3 -
irias 3 -
ardes 3 -
erdes 3 -
irdes 3 -
asses 3 -
esses 3 -
isses 3 -
astes 3 -
estes 3 -
istes 3 -
áveis 3 -
áreis 3 -
éreis 3 -
íreis 3 -
araas 3 -
arão 3 -
erão 3 -
irão 3 -
arás 3 -
erás 3 -
irás 3 -
aria 3 -
eria 3 -
iria 3 -
asse 3 -
esse 3 -
isse 3 -
aste 3 -
este 3 -
iste 3 -
arei 3 -
erei 3 -
irei 3 -
aram 3 -
eram 3 -
iram 3 -
avam 2 -
arem 3 -
erem 3 -
irem 3 -
ares 3 -
eres 3 -
ires 3 -
avas 2 -
íeis 3 -
ados 3 -
idos 3 -
ámos 3 -
amos 3 -
emos 3 -
imos 3 -
iras 3 -
ada 2 -
ida 3 -
ará 3 -
ara 3 - prepara
erá 3 -
era 3 - espera considera
irá 3 -
ava 2 -
ado 2 -
ido 3 -
ide 3 -
ode 3 -
ade 3 - abade
ede 3 -
ira 3 - fronteira sátira
eis 3 -
ei 3 -
eu 3 - chapeu
iu 3 -
ou 3 -
ar 2 - lugar bar par mar ar
er 2 - ter ser poder haver qualquer mulher
ir 3 - ir
am 2 -
em 2 - tem bem quem além porém alguém ninguém vem item ordem
ia 2 - estória fatia acia praia elogia mania lábia aprecia polícia arredia cheia ásia dia via família energia teoria memória história economia tecnologia
i 3 -
"""
VOWEL = """
a 3 - ásia
e 3 -
o 3 - ão
"""
# End of the fixed values.

Rule = tuple[str, int, str, tuple[str, ...]]


def rules(table: str) -> list[Rule]:
    out = []
    for line in table.split("\n"):
        if line:
            suffix, least, replacement, *exceptions = line.split(" ")
            out.append((suffix, int(least), replacement.replace("-", ""), tuple(exceptions)))
    return out


#: (name, rules, the ending that a word must have for the step to be tried)
STEPS = [("plural", rules(PLURAL), "s"), ("feminine", rules(FEMININE), "a"), ("adverb", rules(ADVERB), ""), ("augmentative", rules(AUGMENTATIVE), ""), ("nominal", rules(NOMINAL), ""), ("verbal", rules(VERBAL), ""), ("vowel", rules(VOWEL), "")]
_BY_END = {name: {c: [r for r in table if r[0].endswith(c)] for c in {r[0][-1] for r in table}} for name, table, _ in STEPS}
_AFTER = {"verbal": "nominal", "vowel": "verbal"}  # tried only if the step before changed nothing


def _step(state: Column, table: list[Rule], ending: str, conditional: bool) -> Column:
    """state: struct(word, changed, done). A step that is skipped or stopped by an exception has changed nothing."""
    word = state["word"]
    made = lambda w, changed, done: F.struct(w.alias("word"), F.lit(changed).alias("changed"), done.alias("done"))
    same = made(word, False, state["done"])
    out = F.when(F.length(word) < 0, same)
    if conditional:
        out = out.when(state["done"], same)
    if ending:
        out = out.when(~F.endswith(word, F.lit(ending)), same)
    for suffix, least, replacement, exceptions in table:
        fits = F.endswith(word, F.lit(suffix)) & (F.length(word) >= len(suffix) + least)
        if exceptions:
            out = out.when(fits & word.isin(*exceptions), same)
        out = out.when(fits, made(F.concat(F.substring(word, F.lit(1), F.length(word) - len(suffix)), F.lit(replacement)), True, state["done"]))
    return out.otherwise(same)


def _states(word: Column) -> list:
    """Functions from one state to the next, a step each."""
    out = []
    for name, table, ending in STEPS:

        def step(state: Column, name=name, table=table, ending=ending) -> Column:
            new = _step(state, table, ending, name in _AFTER)
            done = name in ("nominal", "verbal")
            return bind(new, lambda s: F.struct(s["word"].alias("word"), s["changed"].alias("changed"), (s["done"] | s["changed"] if done else s["done"]).alias("done")))

        out.append((name, step))
    return out


def stem_expression(word: Column) -> Column:
    """The stem of a word in built-in functions alone: for a few words, as the chain of rules is long. Words of under three characters only lose their accents."""

    def run(w: Column) -> Column:
        def chain(state: Column, steps: list) -> Column:
            return bind(steps[0][1](state), lambda s: chain(s, steps[1:])) if steps else state["word"]

        start = F.struct(w.alias("word"), F.lit(False).alias("changed"), F.lit(False).alias("done"))
        return without_accents(F.when(F.length(w) < 3, w).otherwise(bind(start, lambda s: chain(s, _states(w)))))

    return bind(F.lower(stripped(word)), run)


def explained(word: Column) -> Column:
    """The steps that changed a word: array of (step, before, after)."""

    def run(w: Column) -> Column:
        def chain(state: Column, steps: list, seen: Column) -> Column:
            if not steps:
                plain = without_accents(state["word"])
                return F.concat(seen, F.array(F.struct(F.lit("accents").alias("step"), state["word"].alias("before"), plain.alias("after"))))
            name, step = steps[0]
            entry = lambda s: F.struct(F.lit(name).alias("step"), state["word"].alias("before"), s["word"].alias("after"))
            return bind(step(state), lambda s: chain(s, steps[1:], F.concat(seen, F.array(entry(s)))))

        start = F.struct(w.alias("word"), F.lit(False).alias("changed"), F.lit(False).alias("done"))
        plain = F.array(F.struct(F.lit("accents").alias("step"), w.alias("before"), without_accents(w).alias("after")))
        every = F.when(F.length(w) < 3, plain).otherwise(bind(start, lambda s: chain(s, _states(w), F.array().cast("array<struct<step:string,before:string,after:string>>"))))
        return F.filter(every, lambda e: e["before"] != e["after"])

    return bind(F.lower(stripped(word)), run)


def stem_of(word: str) -> str:
    """``stem`` on the driver, for the words of a query."""
    from .text import fold

    word = word.lower().strip()
    if len(word) < 3:
        return fold(word)
    changed = {}
    for name, table, ending in STEPS:
        if changed.get(_AFTER.get(name)) or not word.endswith(ending):
            changed[name] = changed.get(_AFTER.get(name), False)
            continue
        fit = next((r for r in _BY_END[name].get(word[-1:], ()) if word.endswith(r[0]) and len(word) - len(r[0]) >= r[1]), None)
        changed[name] = fit is not None and word not in fit[3]
        if changed[name]:
            word = word[: len(word) - len(fit[0])] + fit[2]
    return fold(word)


@F.pandas_udf(T.StringType())
def _stemmed(words: pd.Series) -> pd.Series:
    known: dict[str, str] = {}
    return words.map(lambda w: known[w] if w in known else known.setdefault(w, stem_of(w)), na_action="ignore")


def stem(word: Column) -> Column:
    """The stem of a word, for vocabularies."""
    return _stemmed(word)


def stem_sql(source: str, word: str) -> str:
    """Chained common table expressions over ``source`` (with the column ``word``): the last is ``stems(word, stem)``."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    parts = [f"s0 AS (SELECT {word} AS word, {word} AS w, false AS done FROM {source})"]
    for i, (name, table, ending) in enumerate(STEPS):
        cases = ["WHEN length(w) < 3 THEN w"]
        if name in _AFTER:
            cases.append("WHEN done THEN w")
        if ending:
            cases.append(f"WHEN NOT ends_with(w, {quote(ending)}) THEN w")
        hits = []
        for suffix, least, replacement, exceptions in table:
            fits = f"ends_with(w, {quote(suffix)}) AND length(w) >= {len(suffix) + least}"
            if exceptions:
                cases.append(f"WHEN {fits} AND w IN ({', '.join(map(quote, exceptions))}) THEN w")
                hits.append(f"WHEN {fits} AND w IN ({', '.join(map(quote, exceptions))}) THEN false")
            cases.append(f"WHEN {fits} THEN substr(w, 1, length(w) - {len(suffix)}) || {quote(replacement)}")
            hits.append(f"WHEN {fits} THEN true")
        done = f"done OR (length(w) >= 3 AND NOT done AND CASE {' '.join(hits)} ELSE false END)" if name in ("nominal", "verbal") else "done"
        parts.append(f"s{i + 1} AS (SELECT word, CASE {' '.join(cases)} ELSE w END AS w, {done} AS done FROM s{i})")
    parts.append(f"stems AS (SELECT word, strip_accents(w) AS stem FROM s{len(STEPS)})")
    return ", ".join(parts)
