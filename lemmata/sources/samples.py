"""Sentences of our own, from which the character sets' statistics are learned."""

SAMPLES = {
    "western": (
        "Soit f une fonction continue sur un intervalle fermé. Démontrons que l'équation possède une solution réelle, à côté de celles déjà trouvées. "
        "Théorème général: là où la série converge, la limite est unique. L'œuvre de Poincaré a été créée en français; être, même, où, façon, naïve. Étant donné un élément à gauche, ça va. "
        "Sei f eine stetige Funktion über einer abgeschlossenen Menge. Für jede Folge größer als null gibt es ein Maß, das die Lösung erfüllt; Übung: Größe, Schluß, Ähnlichkeit, möglich, natürlich, Körper. "
        "Sea f una función continua. Según la definición, existe una solución única; demostración: ¿qué señal añade más? También aquí, así, después, número, pequeño, ¡cómo! "
        "Seja f uma função contínua: a solução não é única, então há uma equação, três razões. "
        "Perché la funzione è continua, così la città è più grande; già, però, verità. "
        "Låt f vara en funktion på mängden; för varje följd är gränsvärdet större. Lad være at gå på; øvelse, ægte, årsag."
    ),
    "central": (
        "Niech f będzie funkcją ciągłą. Wówczas istnieje dokładnie jedno rozwiązanie; twierdzenie: każdy ciąg ograniczony ma podciąg zbieżny. Dowód: załóżmy, że mnożąc przez liczbę większą, wciąż się mieścimy; źródło, próba, świat, łatwo, część. "
        "Nechť f je spojitá funkce. Každá posloupnost má nejvýše jednu limitu, což je důsledek věty; řešení rovnice, příklad, důkaz, množina, větší, čísla, že, když, při. "
        "Legyen f folytonos függvény. Minden korlátos sorozatnak van sűrűsödési pontja, erről szól a tétel; bizonyítás, megoldás, így, először, összeg, különböző, tőle. "
        "Neka je f neprekidna funkcija; skup je zatvoren, što znači da može: rješenje, veći, niža, čest, žele."
    ),
    "cyrillic": (
        "Пусть дана непрерывная функция на отрезке. Теорема: всякая ограниченная последовательность имеет предел. Доказательство. Рассмотрим множество всех решений уравнения и покажем, что оно не пусто. "
        "Определение компактного пространства приведено ниже; это число больше нуля, если только для каждого элемента найдётся окрестность. Следствие, лемма, пример. Объём, ещё, щель, цель, юг, эта."
    ),
    "greek": (
        "Έστω μια συνεχής συνάρτηση σε κλειστό διάστημα. Θεώρημα: κάθε φραγμένη ακολουθία έχει συγκλίνουσα υπακολουθία. Απόδειξη. Θεωρούμε το σύνολο όλων των λύσεων της εξίσωσης και δείχνουμε ότι δεν είναι κενό. "
        "Ο ορισμός του χώρου δίνεται παρακάτω· ο αριθμός είναι μεγαλύτερος από το μηδέν, για κάθε στοιχείο υπάρχει περιοχή. Λήμμα, παράδειγμα, πόρισμα, ώστε, ψάχνω, ξέρω."
    ),
    "hebrew": (
        "תהי פונקציה רציפה על קטע סגור. משפט: לכל סדרה חסומה יש תת סדרה מתכנסת. הוכחה. נתבונן בקבוצת כל הפתרונות של המשוואה ונראה שהיא אינה ריקה. "
        "הגדרה של מרחב קומפקטי ניתנת להלן, מספר גדול מאפס אם ורק אם לכל איבר קיימת סביבה. למה, דוגמה, מסקנה, צריך, טוב, עוד, זה."
    ),
    "arabic": (
        "لتكن دالة متصلة على فترة مغلقة. مبرهنة: كل متتالية محدودة لها متتالية جزئية متقاربة. البرهان. نعتبر مجموعة كل حلول المعادلة ونبين أنها غير خالية. "
        "تعريف الفضاء المتراص يرد أدناه، والعدد أكبر من الصفر إذا وفقط إذا كان لكل عنصر جوار. مثال، نتيجة، ضرب، ظل، خط، ثم، هذا، على، إلى، شيء."
    ),
    "japanese": (
        "連続な関数を考える。定理。有界な数列は収束する部分列を持つ。証明は次のとおりである。方程式の解の集合が空でないことを示そう。コンパクトな空間の定義を述べる。集合の元について、ある数が存在して条件を満たすとする。"
        "このとき命題が成り立つことがわかった。ベクトル空間、グラフ、データ、モデルについても同様であり、例えば補題から系が従う。なお、これらの結果は以下で用いられる。"
    ),
    "simplified": (
        "设函数在闭区间上连续。定理：任何有界数列都有收敛的子列。证明。我们考虑方程的所有解的集合，并证明它不是空集。紧空间的定义如下，对于每一个元素，存在一个数使得条件成立。"
        "因此这个命题是正确的，可以得到下面的结果。如果它在这里不成立，那么就有一个例子说明问题。引理和推论也是一样，其中的数学对象为向量空间，这里的方法与前面的相同。"
    ),
    "traditional": (
        "設函數在閉區間上連續。定理：任何有界數列都有收斂的子列。證明。我們考慮方程的所有解的集合，並證明它不是空集。緊空間的定義如下，對於每一個元素，存在一個數使得條件成立。"
        "因此這個命題是正確的，可以得到下面的結果。如果它在這裡不成立，那麼就有一個例子說明問題。引理和推論也是一樣，其中的數學對象為向量空間，這裡的方法與前面的相同。"
    ),
    "korean": (
        "닫힌 구간에서 연속인 함수를 생각하자. 정리: 유계인 모든 수열은 수렴하는 부분수열을 가진다. 증명. 방정식의 모든 해의 집합이 공집합이 아님을 보이자. 콤팩트 공간의 정의는 다음과 같다. "
        "각 원소에 대하여 조건을 만족하는 수가 존재한다고 하자. 이때 명제가 성립하는 것을 알 수 있으며, 그러므로 보조정리와 따름정리를 얻는다. 이 결과는 예를 들어 벡터 공간에도 적용된다."
    ),
}
