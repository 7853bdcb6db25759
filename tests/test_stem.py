"""Porter's own examples."""

import pytest

from lodestone.functions.stem import porter

CASES = "caresses:caress ponies:poni ties:ti caress:caress cats:cat feed:feed agreed:agre plastered:plaster bled:bled motoring:motor sing:sing conflated:conflat troubled:troubl sized:size hopping:hop tanned:tan falling:fall hissing:hiss fizzed:fizz failing:fail filing:file happy:happi sky:sky relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous sensibiliti:sensibl triplicate:triplic formative:form formalize:formal electrical:electr hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin adjustable:adjust irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communism:commun activate:activ homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas controll:control roll:roll"


@pytest.mark.parametrize("case", CASES.split())
def test_examples(case):
    word, stem = case.split(":")
    assert porter(word) == stem


def test_other_words_pass():
    assert porter("été") == "été" and porter("ab") == "ab" and porter("x1ing") == "x1ing"
