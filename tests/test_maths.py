"""Mathematics: LaTeX to characters and MathML to LaTeX, each construct by hand."""

from __future__ import annotations

import xml.etree.ElementTree as ET

import pytest
from pyspark.sql import functions as F

from siltstone.functions import maths
from siltstone.sources.attachments import book_sections


@pytest.mark.parametrize(
    ("text", "want"),
    [
        (r"carbon dioxide ($\text{CO}_2$)", "carbon dioxide (CO₂)"), (r"$\ce{6CO2 + 6H2O -> C6H12O6 + 6O2}$", "6CO₂ + 6H₂O → C₆H₁₂O₆ + 6O₂"), ("$E = mc^2$", "E = mc²"), (r"\(v = \frac{d}{t}\)", "v = d/t"),
        (r"$$\text{speed} = \frac{100\ \text{km}}{2\ \text{h}} = 50\text{ km/h}$$", "speed = (100 km)/(2 h) = 50 km/h"), (r"$3 \times 10^{8}$ m/s", "3 × 10⁸ m/s"), (r"$20\,^\circ$C", "20 °C"), (r"\(\Delta G \leq 0\)", "ΔG ≤ 0"), (r"$\sqrt{a^2 + b^2}$", "√(a² + b²)"),
        ("$x_{max}$", "xₘₐₓ"), ("$v_{best}$", "v_(best)"), ("CO_2 and H_2O", "CO₂ and H₂O"), ("Ca_3(PO_4)_2", "Ca₃(PO₄)₂"), ("It costs $5 to $10", "It costs $5 to $10"), ("> $x^2$", "> $x^2$"), (r"$\sqrt[3]{8}$", "³√8"), (r"$\frac{\frac{1}{2}}{3}$", "(1/2)/3"),
        (r"a \times b", "a × b"), (r"C:\dir\file", r"C:\dir\file"), (r"$x^{y+1}$", "x^(y+1)"), (r"$\frac12$", "1/2"), (r"${unclosed \alpha$", "unclosed α"), ("snake_case_name", "snake_case_name"), (None, None), ("", ""), (r"$\left( x \right)$", "( x )"), (r"\[a \\ b\]", "a b"),
    ],
)
def test_latex(text, want):
    assert maths.shown(text) == want


@pytest.mark.parametrize(
    ("markup", "want"),
    [
        ("<mfrac><mn>1</mn><mi>π</mi></mfrac>", r"\frac{1}{\pi}"), ("<msup><mi>x</mi><mn>2</mn></msup>", "{x}^{2}"), ("<msubsup><mi>x</mi><mn>1</mn><mn>2</mn></msubsup>", "{x}_{1}^{2}"), ("<msqrt><mi>a</mi><mo>+</mo><mi>b</mi></msqrt>", r"\sqrt{a+b}"),
        ("<mroot><mn>8</mn><mn>3</mn></mroot>", r"\sqrt[3]{8}"), ("<mrow><mi>π</mi><mi>r</mi></mrow>", r"\pi r"), ("<mfenced open='[' close=']'><mi>a</mi><mi>b</mi></mfenced>", r"\left[ a,b \right]"), ("<mover><mn>3</mn><mo>¯</mo></mover>", r"\overline{3}"),
        ("<mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd><mn>3</mn></mtd></mtr></mtable>", r"\begin{matrix} 1 & 2 \\ 3 \end{matrix}"), ("<mtext>if  so</mtext>", r"\text{if so}"), ("<mphantom><mn>1</mn></mphantom>", ""),
        ("<semantics><mn>4</mn><annotation>no</annotation></semantics>", "4"), ("<menclose notation='radical'><mn>2</mn></menclose>", r"\sqrt{2}"), ("<mfrac><mn>1</mn></mfrac>", "1"), ("<mo>−</mo>", "-"), ("<odd>x</odd>", "x"), ("<munder><mo>∑</mo><mi>i</mi></munder>", "{∑}_{i}"),
    ],
)
def test_mathml(markup, want):
    assert maths.latex(ET.fromstring(f"<math xmlns='http://www.w3.org/1998/Math/MathML'>{markup}</math>")) == want


def test_columns_and_books(spark):
    df = spark.createDataFrame([("$x^2$", "<math><msup><mi>x</mi><mn>2</mn></msup></math>"), (None, "<math>"), ("plain", None)], "t string, m string")
    assert [tuple(r) for r in df.select(maths.readable(F.col("t")), maths.from_mathml(F.col("m"))).collect()] == [("x²", "{x}^{2}"), (None, None), ("plain", None)]
    book = b"<document xmlns:m='http://www.w3.org/1998/Math/MathML'><content><section><title>One</title><para>Half is <m:math><m:mfrac><m:mn>1</m:mn><m:mn>2</m:mn></m:mfrac></m:math> of it.</para></section></content></document>"
    assert book_sections(book, as_latex=True) == [("One", r"Half is $\frac{1}{2}$ of it.")]
