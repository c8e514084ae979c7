"""Stems against published pairs of the algorithm's sample vocabulary and of its description."""

from loomspark.functions.stemmer import with_stems

PAIRS = """consign consign consigned consign consigning consign consignment consign consist consist consisted consist
 consistency consist consistent consist consistently consist consisting consist consists consist consolation consol
 consolations consol consolatory consolatori console consol consoled consol consoles consol consolidate consolid
 consolidated consolid consolidating consolid consoling consol consolingly consol consols consol consonant conson
 consort consort consorted consort consorting consort conspicuous conspicu conspicuously conspicu conspiracy conspiraci
 conspirator conspir conspirators conspir conspire conspir conspired conspir conspiring conspir constable constabl
 constables constabl constance constanc constancy constanc constant constant knack knack knackeries knackeri knacks knack
 knag knag knave knave knaves knave knavish knavish kneaded knead kneading knead knee knee kneel kneel kneeled kneel
 kneeling kneel kneels kneel knees knee knell knell knelt knelt knew knew knick knick knif knif knife knife knight knight
 knightly knight knights knight knit knit knits knit knitted knit knitting knit knives knive knob knob knobs knob
 knock knock knocked knock knocker knocker knockers knocker knocking knock knocks knock knopp knopp knot knot knots knot
 skis ski skies sky dying die lying lie tying tie idly idl gently gentl ugly ugli early earli only onli singly singl
 sky sky news news howe howe atlas atlas cosmos cosmos bias bias andes andes
 inning inning innings inning outing outing herring herring proceed proceed proceeds proceed exceed exceed succeeds succeed
 ties tie cries cri gas gas this this gaps gap kiwis kiwi caresses caress luxuriated luxuri hopping hop hoping hope
 hoped hope cry cri by by say say bed bed bead bead beds bed shed shed aged age using use being be
 general general generate generat generously generous communication communic community communiti arsenal arsenal
 relational relat conditional condit rational ration valency valenc digitizer digit conformably conform radically radic
 differently differ vilely vile analogously analog operator oper feudalism feudal decisiveness decis hopefulness hope
 callousness callous formality formal sensitivity sensit sensibility sensibl triplicate triplic formative format
 formalize formal electricity electr electrical electr hopeful hope goodness good revival reviv allowance allow
 inference infer airliner airlin adjustable adjust defensible defens irritant irrit replacement replac adjustment adjust
 dependent depend adoption adopt communism communism activate activ angularity angular homologous homolog effective effect
 probate probat rate rate cease ceas controlling control rolling roll fluently fluentli youth youth boyish boyish
 say's say 'tis tis a a is is yes yes happy happi sized size bled bled""".split()


def test_published_pairs(spark):
    words, stems = PAIRS[0::2], PAIRS[1::2]
    got = {r.word: r.stem for r in with_stems(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert {w: (got[w], s) for w, s in zip(words, stems, strict=True) if got[w] != s} == {}
