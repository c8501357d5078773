"""The C++ grammar: texts that parse and texts that do not, and the other grammars beside it."""

import pytest

from quarryline.llm.grammars import classify, cpp_problem, ranking

BROKEN = [
    'if x { return 1; }',
    'void f() { if x { return 1; } }',
    'class A { public int x };',
    'class A { public int x; };',
    'void f() { for (;;;;) {} }',
    'for (;;;;) {}',
    'int x y z;',
    'plain words that are nothing at all;',
    'void f() { int x y z; }',
    'int f() { a = ; }',
    'void f() { g(a,,b); }',
    'void f() { g(a,); }',
    'void f() { return return; }',
    'int f( { }',
    'void f() { x = 1 2; }',
    'void f() { while { } }',
    'void f() { a b c d e; }',
    'static v',
    'struct A { int x; } int y(',
    'void f() { if () { } }',
    'enum E { A, B C D };',
    'void f() { x + ; }',
    'class { ',
    'void f() { else { } } )',
    'void f() { int a[3 = {1}; }',
    'void f() { foo(1)) ; }',
    'int 3x = 4;',
    'void f() { case; }',
    'void f() { x = * 3 / ; }',
    'void f() { do { } }',
    'namespace a { int x }',
    'class A { int x }',
    'void f() { a->; }',
    'void f() { a.b. = 3; }',
]
SOUND = [
    'int main() { return 0; }',
    'template <class T, int N = 3> struct A<T*, N> : public B<T>, private C { A() : x(1), y{2} {} ~A() = default; int x, y{3}; T* p = nullptr; enum { a = 1, b, }; operator bool() const { return x; } bool operator()(int a) const noexcept override; A& operator[](int i); friend std::ostream& operator<<(std::ostream& o, const A& a) { return o << a.x; } };',
    'void f() { for (auto& [k, v] : m) { g(k); } for (int i = 0; i < 3; ++i) ; for (;;) { break; } while (true) do { x--; } while (x > 0); }',
    'void f() { switch (x) { case A::b: case 3: g(); break; default: return; } }',
    'auto l = [this, &x, y = std::move(z)](int a) mutable -> int { return a; };',
    'extern "C" { int f(void); }',
    'extern "x" int g();',
    'namespace a::b { namespace { int x; } }',
    'using namespace std; using A = B<C>; typedef int (*fn)(int, char*);',
    'static_assert(sizeof(int) == 4, "x");',
    'Q_OBJECT class A { Q_OBJECT public: A(); signals: void x(); public Q_SLOTS: void y(); };',
    'EXPORT_API int foo(int) NOEXCEPT_X;',
    'class EXPORT Foo final : public Bar { };',
    'BEGIN_NS int x; END_NS',
    'TEST(A, b) { EXPECT_EQ(1, 2) << "x"; }',
    'template <typename T> requires C<T> auto f(T t) -> decltype(t.x()) { return t.x(); }',
    'template <class T> concept X = requires(T t) { { t.f() } -> Y<int>; typename T::z; t.g(); };',
    'int a[] = {1, 2, 3,}; int b[3][4] = {{1, 2}, {3}};',
    'struct P p = { .x = 1, .y = {2} };',
    'void f() try { g(); } catch (const E& e) { h(); } catch (...) { throw; }',
    'int x = a ? b : c; int y = (a < b) ? f<int>(x) : -1;',
    'A::A(int x) : B(x), c_{x}, d_(f<T>(x)) { }',
    'int (*fp)(int) = &g; void (A::*mp)(int) const = &A::f;',
    '[[nodiscard]] int f(); void g [[noreturn]] ();',
    'unsigned long long x = 5ull << 3;',
    'void f() { x >>= 2; y = a >> b; z = v<w<int>>(); delete[] p; new (q) A(1); auto* r = new int[5]; }',
    'void f() { goto end; end: return; }',
    'union U { int a; float b; } u;',
    'enum class E : uint8_t { A = 1, B };',
    'void f(int, char* = nullptr, ...);',
    'template <class... A> void f(A&&... a) { (g(a), ...); return (a + ... + 0); }',
    'friend class X;',
    'template class A<int>; extern template class B<int>; template <> struct C<int> {};',
    'A operator+(const A& a, const A& b);',
    'bool A::operator==(const A& o) const { return x == o.x; }',
    'auto f = [] { return 1; }(); int g([](int x) { return x; }(3));',
    'void f() { if constexpr (a) b(); else if (c) d(); else { e(); } if (auto it = m.find(k); it != m.end()) { } }',
    'void f() { FOREACH(x, y) { } }',
    'const char* s = "x" "x" PRIu64 "x";',
    'asm("x" : "x"(x) : "x"(y));',
    'void f() { asm volatile ("x" ::: "x"); }',
    'struct A { int a : 3; unsigned : 4; int b : 2 = 1; };',
    'thread_local static int x;',
    'int f(int a) const&; int g() &&;',
    'task f() { co_await x; co_return 1; }',
    'export module a.b; import std; export int f();',
    'A<B<C>> x; std::map<int, std::vector<A*>> y; A<(1 > 2)> z;',
    'void f() { a<b>(c); std::function<void(int)> g = nullptr; static_cast<int>(x); }',
    'void operator delete(void* p) noexcept; void* operator new[](size_t n);',
    'typename T::value_type x; typename std::enable_if<A<T>::value, int>::type y = 0;',
    'int f() { return {1, 2}; }',
    'B b{}; auto c = B{1}; B d = {};',
    'inline namespace v1 { }',
    'namespace a = b::c;',
    'DECLARE_X(a, b)\nint z;',
    'int x; ; int y;',
    'struct A { A(const A&) = delete; A& operator=(A&&) noexcept = default; virtual void f() = 0; explicit operator int() const; };',
    'void f() { label: x(); while (x) y(); }',
    'decltype(auto) f(); decltype(x) y; alignas(16) int z; struct alignas(8) Q { };',
    'int*const*p; int&r=x; char**argv;',
    'auto x = -1 + ~y - !z * *p & &q;',
    'void f() { int i; i++; ++i; i = i++ + ++i; }',
    'void f() { throw E("x");}',
    'int y = L"x";',
    'auto [a, b] = f(); auto& [c, d] = g;',
    'void f() { struct L { int x; } l; class M { public: int y; }; M m; }',
    'typedef struct { int x; } T; typedef enum E { A } E;',
    'int f(a, b) int a; char b; { return a; }',
    'void f(void (*cb)(int), int (&arr)[3], int n[]);',
    'template <template <class> class C> struct X { };',
    'template <auto V, class = void> struct X;',
    'A(int) -> A<int>;',
    'constexpr auto x = []<class T>(T t) { return t; };',
    'void f() { for (int i = 0, j = 1; i < n && j > 0; i++, --j) { continue; } }',
    'static const struct A a[] = { { 1, "x" }, { 2, "x" }, };',
    'foo(a, b)\nbar(c)',
    'void f() { int(x); x = (int)y; z = (A*)p; w = sizeof(int) * 3; v = sizeof x; }',
    'void f() { return; } ;',
    'void f() { std::cout << a << "x" << std::endl; }',
    'void f() { if (a) ; else b(); }',
    'void f() { if (x) { } else if (y) { } else { } }',
    'int x = 1000;',
    'a::b::c d; ::e::f g; ::h();',
    'using std::swap; using A::B;',
    'struct S : T { using T::T; using typename T::X; };',
    'class A; struct B; enum E : int;',
    'void f() { throw; }',
    'int f() { switch (x) case 1: return 2; return 3; }',
]
#: Directives, digraphs, and what is switched off.
SOUND += [
    "#if 0\nit's not code (\n#endif\nint x;",
    "#if 0\n{ {\n#if A\n(\n#else\n#endif\n#else\nint z;\n#endif",
    "int f() <% int a<:3:>; return a<:0:>; %>",
    "%:define X 1\nint y = X;",
    "int x;\n#error don't\n",
    "",
]
BROKEN += ["#if A\nint x;\n#elif B\nint x y z;\n#else\nint z;\n#endif", "#else\nint x;"]


@pytest.mark.parametrize("text", SOUND)
def test_sound(text):
    assert cpp_problem(text) is None


@pytest.mark.parametrize("text", BROKEN)
def test_broken(text):
    assert cpp_problem(text) is not None and classify(text)[0] != "valid"


def test_cut_off_anywhere():
    text = "int f(int a) { if (a > 3) { g(a, { 1, 2 }); } return a; }"
    assert cpp_problem(text) is None
    assert all(cpp_problem(text[:n]) for n in range(4, len(text)) if text[:n].rstrip())


def test_deep_and_long():
    assert cpp_problem("int x = " + "(" * 3000 + "1" + ")" * 3000 + ";") is None
    assert cpp_problem("int f() { " + "a(b, c); " * 50000 + "}") is None


def test_sql_in_one_line():
    assert classify("SELECT a FROM b;") == ("foreign", "sql")


def test_ranking_holds_every_language():
    assert {language for _, language in ranking("int x;")} >= {"c++", "python", "shell", "script", "java", "sql", "css", "binary"}
